"""Token counts from a compiled deterministic transducer.

A SentencePiece BPE model is compiled into a transducer over characters whose transitions carry emitted-token counts. It rests on one property of BPE: a
sequence of pieces is the encoding of its text if and only if each piece encodes to
itself and each neighbouring pair encodes to itself. So the last piece of a prefix is the only
one that encodes to itself and fits the last piece of the prefix before it. A state needs, for each
suffix that begins some piece, the piece before that suffix and the count there relative to now. What single pieces lead to is compiled ahead;
states that only neighbours of pieces lead to are added where a text first meets them, as every state is: by its definition, not by the text.

A word mark after any other character is a reset: no piece of the model spans it, so what follows does not depend on the state there.
Runs of word marks merge after all else and by themselves; a state carries their number and whether the word's first piece is the lone mark, until the word ends.

A chunk is a map from the state before it to the state behind it and the tokens emitted on the way. It holds the run from the initial state as
checkpoints: from any other state only the characters up to a checkpoint where both runs are in one state must be walked, and none behind the first reset.
Such maps compose associatively, and the chunks of a long text are combined by a tree-shaped prefix scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pick

MARK = "▁"
CHUNK = 1 << 16
#: Characters between the checkpoints of a run.
STRIDE = 64
LIMIT = 4096
CACHE = 300_000
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: A text's state: marks that lead the word, whether its first piece is the lone mark (None: not settled yet), the transducer's state, and the last character.
State = tuple[int, bool | None, int, str]
FRESH: State = (0, False, 0, "")


class Run(NamedTuple):
    """What a stretch without a reset does to a state: the run over it from a fresh one, with checkpoints (characters, state, tokens) on the way."""

    text: str
    marks: list[tuple[int, int, int]]
    end: int
    count: int


class ChunkMap(NamedTuple):
    """What a chunk does to a state: the stretches before its first reset, in order, and the tokens and the state behind it, which are the same from any state."""

    runs: tuple[Run, ...]
    rest: tuple[int, State] | None


_RESET = re.compile(f"[^{MARK}](?={MARK})")
_compiled: dict[str, "Transducer"] = {}


class Transducer:
    """Counts the tokens of a SentencePiece BPE model with an identity normaliser."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.rank: dict[str, int] = {}
        self.runs: set[int] = set()
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                p = sp.id_to_piece(i)
                if set(p) == {MARK}:
                    self.runs.add(len(p))
                    if len(p) > 1:
                        continue  # runs merge after all else, by themselves
                if MARK in p[1:]:
                    raise ValueError(f"a piece spans a word mark: {p!r}")
                self.rank[p] = i
        #: Neighbouring characters that some piece holds; between any others no merge can happen.
        self.bonds = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.prefixes = {p[:n] for p in self.rank for n in range(1, len(p))}
        self.itself: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.run_memo: dict[int, int] = {0: 0, 1: 1}
        self.clear()

    def clear(self) -> None:
        """Only the initial states: nothing told of the first piece (None), or settled already (False, True)."""
        #: A state is (longest suffix that begins a piece; for it and each shorter such suffix its length,
        #: the piece before it, the count at its start relative to now, and whether the first piece is a lone mark), as in an Aho-Corasick node.
        self.states: list[tuple[str, tuple[tuple[int, str, int, bool | None], ...]]] = [("", ((0, "", 0, first),)) for first in (False, True, None)]
        self.ids = {x: i for i, x in enumerate(self.states)}
        self.next: list[dict[str, tuple[int, int]]] = [{}, {}, {}]
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.compile()

    def compile(self) -> None:
        """The states that single pieces lead to."""
        for piece in self.rank:
            state = 0
            for ch in piece:
                state, _ = self.next[state].get(ch) or self.step(state, ch)

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: the pair whose piece has the lowest rank first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_token(self, p: str) -> bool:
        if p not in self.itself:
            self.itself[p] = p in self.rank and len(self.merge(p)) == 1
        return self.itself[p]

    def fit(self, a: str, b: str) -> bool:
        if (a, b) not in self.fits:
            if len(self.fits) > CACHE:
                self.fits.clear()
            self.fits[a, b] = self.merge(a + b) == [a, b]
        return self.fits[a, b]

    def step(self, state: int, ch: str) -> tuple[int, int]:
        """The next state and the emitted count (it may be negative: a longer piece takes shorter ones back)."""
        text, open_ = self.states[state]
        left, first = (), open_[-1][3]
        if ch not in self.rank:
            emitted, piece = len(ch.encode("utf-8", "surrogatepass")), ""  # a token a byte; nothing merges with it
            first = bool(first)
        else:
            for n, before, rel, told in open_:
                piece = text[len(text) - n :] + ch
                if piece in self.rank and self.is_token(piece) and (not before or self.fit(before, piece)):
                    emitted, first = rel + 1, piece == MARK if told is None else told
                    break
            left = tuple((n + 1, before, rel - emitted, told) for n, before, rel, told in open_ if text[len(text) - n :] + ch in self.prefixes)
        size = left[0][0] if left else 0
        new = ((text + ch)[len(text) + 1 - size :], (*left, (0, piece, 0, first)))
        if new not in self.ids:
            self.ids[new] = len(self.states)
            self.states.append(new)
            self.next.append({})
        self.next[state][ch] = out = (self.ids[new], emitted)
        return out

    def settled(self, state: int) -> tuple[int, bool | None]:
        """The state with the first piece left out, and whether that is the lone mark; None, and the state itself, while the suffixes differ on it."""
        text, open_ = self.states[state]
        told = {x[3] for x in open_}
        if len(told) > 1 or None in told:
            return state, None
        plain = (text, tuple((n, before, rel, False) for n, before, rel, _ in open_))
        if plain not in self.ids:
            self.ids[plain] = len(self.states)
            self.states.append(plain)
            self.next.append({})
        return self.ids[plain], told.pop()

    def run(self, n: int) -> int:
        """Tokens of n word marks in a row: each takes as many marks as pieces allow, leftmost first."""
        if n in self.run_memo:
            return self.run_memo[n]
        import heapq

        size, left, right = [1] * n, [i - 1 for i in range(n)], [i + 1 for i in range(n)]
        heap = [(i, 1, 1) for i in range(n - 1) if 2 in self.runs]
        count = n
        while heap:
            i, a, b = heapq.heappop(heap)
            j = right[i] if size[i] else n
            if not size[i] or j >= n or (size[i], size[j]) != (a, b):
                continue
            size[i], size[j] = a + b, 0
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
                if a + b + size[right[i]] in self.runs:
                    heapq.heappush(heap, (i, a + b, size[right[i]]))
            if left[i] >= 0 and a + b + size[left[i]] in self.runs:
                heapq.heappush(heap, (left[i], size[left[i]], a + b))
            count -= 1
        if len(self.run_memo) < CACHE:
            self.run_memo[n] = count
        return count

    def owed(self, marks: int, alone: bool | None) -> int:
        """What a run of marks adds to the tokens of its word, for which one mark was counted."""
        return 0 if marks < 2 else self.run(marks) - 1 if alone else self.run(marks - 1)

    def word(self, w: str) -> int:
        """Tokens of one reset-to-reset stretch: marks, then a body or none."""
        found = self.words.get(w)
        if found is None:
            body = w.lstrip(MARK)
            if len(body) == len(w) - 1:
                found = self.walk(w)
            else:
                (marks, alone, state, _), found = self.read(FRESH, w)
                found += self.owed(marks, self.lone(alone, state))
            if len(self.states) > CACHE:
                self.clear()
            for memo in (self.words, self.parts):
                if len(memo) > CACHE:
                    memo.clear()
            if len(w) <= 64:
                self.words[w] = found
        return found

    def read_words(self, words: list[str]) -> int:
        get, n = self.words.get, 0
        for w in words:
            k = get(w)
            n += self.word(w) if k is None else k
        return n

    def lone(self, alone: bool | None, state: int) -> bool:
        return self.states[state][1][-1][3] if alone is None else alone

    def walk(self, w: str) -> int:
        """The counts emitted along w, which holds a mark at its start at most."""
        bonds, total, at = self.bonds, 0, 0
        for i in range(1, len(w) + 1):
            if i < len(w) and w[i - 1 : i + 1] in bonds:
                continue
            part, at = w[at:i], i
            n = self.parts.get(part)
            if n is None:
                state, n = 0, 0
                for ch in part:
                    state, emitted = self.next[state].get(ch) or self.step(state, ch)
                    n += emitted
                if len(part) <= 64:
                    self.parts[part] = n
            total += n
        return total

    def read(self, s: State, text: str, marks: list[tuple[int, int, int]] | None = None) -> tuple[State, int]:
        """The state behind a text that holds no reset, and the tokens emitted; checkpoints are added to ``marks`` if there is a list."""
        lead, alone, state, last = s
        total = 0
        for i, ch in enumerate(text):
            if ch == MARK:
                # the word begins, or its marks go on: one is counted, the others are owed
                lead += 1
                if lead < 3:
                    state, emitted = self.next[0 if lead == 1 else 2].get(ch) or self.step(0 if lead == 1 else 2, ch)
                    total += emitted if lead == 1 else 0
                    alone = False if lead == 1 else None
            else:
                if last + ch not in self.bonds:
                    alone = self.lone(alone, state) if alone is None else alone
                    state = 0  # nothing spans the two characters
                state, emitted = self.next[state].get(ch) or self.step(state, ch)
                total += emitted
                if alone is None:
                    state, alone = self.settled(state)
            last = ch
            if marks is not None and i % STRIDE == STRIDE - 1:
                marks.append((i + 1, state, total))
        return (lead, alone, state, last), total

    def chunk(self, text: str) -> ChunkMap:
        """A chunk's map, made without knowing what comes before it."""
        first = _RESET.search(text)
        head = text if first is None else text[: first.end()]
        marks: list[tuple[int, int, int]] = []
        (_, _, end, _), count = self.read(FRESH, head, marks)
        run = (Run(head, marks, end, count),)
        if first is None:
            return ChunkMap(run, None)
        *words, last = _WORD.findall(text, first.end())
        behind, n = self.read(FRESH, last)
        return ChunkMap(run, (n + self.read_words(words), behind))

    def through(self, run: Run, s: State) -> tuple[State, int]:
        """The state behind a stretch and the tokens emitted; no more of it is walked than up to where its own run is in the same state."""
        before = 0
        if run.text[0] == MARK and s[3] not in ("", MARK):
            before, s = self.owed(s[0], self.lone(s[1], s[2])), FRESH  # its start is a reset
        at = total = 0
        for place, state, count in run.marks:
            s, n = self.read(s, run.text[at:place])
            at, total = place, total + n
            if s[1] is not None and s[2] == state:
                return (s[0], s[1], run.end, run.text[-1]), before + total + run.count - count
        s, n = self.read(s, run.text[at:])
        return s, before + total + n

    def apply(self, m: ChunkMap, s: State) -> tuple[State, int]:
        """The state behind a map's chunks and the tokens emitted, from the state before them."""
        total = 0
        for run in m.runs:
            s, n = self.through(run, s)
            total += n
        return (s, total) if m.rest is None else (m.rest[1], total + self.owed(s[0], self.lone(s[1], s[2])) + m.rest[0])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two chunks in a row: a's state behind it is known once there was a reset, and then b is applied to it."""
        if a.rest is not None:
            s, n = self.apply(b, a.rest[1])
            return ChunkMap(a.runs, (a.rest[0] + n, s))
        if a.runs[-1].text[-1] != MARK and b.runs[0].text[0] == MARK:  # the border is one
            s, n = self.apply(b, FRESH)
            return ChunkMap(a.runs, (n, s))
        return ChunkMap(a.runs + b.runs, b.rest)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        s = MARK + text.replace(" ", MARK)
        if len(s) <= chunk:
            return self.read_words(_WORD.findall(s))  # one chunk, from the state that every text begins with
        maps = [self.chunk(s[i : i + chunk]) for i in range(0, len(s), chunk)]
        while len(maps) > 1:  # one level of the scan's tree
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        (lead, alone, state, _), n = self.apply(maps[0], FRESH)
        return n + self.owed(lead, self.lone(alone, state))


def compiled(model: str) -> Transducer:
    """This worker's transducer for a model file; later batches and tasks go on with its states."""
    if model not in _compiled:
        _compiled[model] = Transducer(model)
    return _compiled[model]


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each whole text.

    A null or empty text has no tokens. Text is one token stream however long; it is walked in
    chunks of ``chunk`` characters. Characters the model lacks count one token for each byte. Repeated rows
    give repeated results; no rows give none. ``model`` is a path that every executor can open.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model)
        for b in batches:
            n, sizes = [], []
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py() or ""
                n.append(t.count(text, chunk))
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(of, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
