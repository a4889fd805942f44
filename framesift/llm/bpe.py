"""Byte-level BPE as a reduction over a tree: encode halves, join neighbours at their boundary.

Two facts make a join exact. Between a non-space and a following space the pre-tokenizer always
starts a new match, whatever stands around them; so what lies between two such places is encoded as
by itself, and the ids outside stay as they were. Inside one long match without spaces, a sequence of tokens
is the encoding of its bytes if and only if each neighbouring pair is; so a re-encoded window around the
boundary is right once it fits its neighbours on both sides. Both windows grow until that holds. The tree's leaves merge by rank here;
no other tokenizer takes part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pick

#: Characters of a text's leaf, and the window at first re-encoded around its ends.
LEAF, WINDOW = 2048, 48
#: Bytes of a match's leaf, which merges by rank alone.
PIECE = 32
#: Matches that are remembered.
CACHE = 1 << 18


class TreeBpe:
    """Encodes and decodes by the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, piece: int = PIECE, window: int = WINDOW):
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks, self.leaf, self.piece, self.window = ranks, leaf, max(1, piece), window
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.pair = lru_cache(1 << 16)(lambda a, b: self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b])
        self.names = [str(i) for i in range(len(self.bytes_of))]
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The base case: while two neighbours join to a token, those of the lowest rank do, the leftmost of equals."""
        rank, n = self.ranks.get, len(piece)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a byte; 0: none does any more
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, e = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != e:
                continue  # one of the two has joined another
            end[i], end[j] = e, 0
            if e < n:
                left[e] = i
                if (r := rank(piece[i : end[e]])) is not None:
                    heappush(heap, (r, i, end[e]))
            if i and (r := rank(piece[left[i] : e])) is not None:
                heappush(heap, (r, left[i], e))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def match(self, piece: bytes) -> list[int]:
        """One match of the pattern: a token as it is, or else the tree of its halves."""
        return [self.ranks[piece]] if piece in self.ranks else self.tree(piece)

    def tree(self, piece: bytes) -> list[int]:
        """Halves, joined by a window that grows until it fits on both sides."""
        if len(piece) <= self.piece:
            return self.merge(piece)
        mid = len(piece) // 2
        return self._join_tokens(self.tree(piece[:mid]), self.tree(piece[mid:]))

    def _join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        w = 2
        while True:
            i, j = max(0, len(a) - w), min(len(b), w)
            ids = self.merge(b"".join(self.bytes_of[t] for t in a[i:] + b[:j]))
            if (i == 0 or self.pair(a[i - 1], ids[0])) and (j == len(b) or self.pair(ids[-1], b[j])):
                return a[:i] + ids + b[j:]
            w *= 2

    def window_ids(self, text: str) -> list[int]:
        """Encodes a leaf or a window, itself no join: match by match, each by its own tree."""
        known, out = self.known, []
        for m in self.pattern.findall(text):
            ids = known.get(m)
            if ids is None:
                ids = self.match(m.encode("utf-8", "replace"))
                if len(m) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[m] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, from the tree of its halves."""
        text = text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")
        cuts = list(range(self.leaf, len(text), self.leaf))
        # a text without a sync point at all is one window: its long matches are halved instead
        nodes, at = [], 0
        for c in [*cuts, len(text)]:
            nodes.append((at, c, self.window_ids(text[at:c])))
            at = c
        while len(nodes) > 1:
            nodes = [self._join(text, *nodes[k : k + 2]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        return nodes[0][2]

    def _join(self, text: str, left: tuple, right: tuple) -> tuple:
        (lo, cut, a), (_, hi, b) = left, right
        w = self.window
        while True:
            i = self._sync_before(text, max(lo, cut - w), cut, lo)
            j = self._sync_after(text, cut, min(hi, cut + w), hi)
            if i is not None and j is not None:
                break
            w *= 4
        drop, take = len(text[i:cut].encode()), len(text[cut:j].encode())
        # tokens end where the sync points are, so whole tokens make up the bytes dropped on either side
        x, n = len(a), 0
        while n < drop:
            x -= 1
            n += len(self.bytes_of[a[x]])
        y, n = 0, 0
        while n < take:
            n += len(self.bytes_of[b[y]])
            y += 1
        del a[x:]
        a += self.window_ids(text[i:j])
        a += b[y:] if y else b
        return lo, hi, a

    @staticmethod
    def _sync_before(text: str, start: int, cut: int, lo: int) -> int | None:
        for p in range(cut - 1, start, -1):
            if text[p].isspace() and not text[p - 1].isspace() and _plain(text[p]) and _plain(text[p - 1]):
                return p
        return lo if start == lo else None

    @staticmethod
    def _sync_after(text: str, cut: int, end: int, hi: int) -> int | None:
        for p in range(cut + 1, end):
            if text[p].isspace() and not text[p - 1].isspace() and _plain(text[p]) and _plain(text[p - 1]):
                return p
        return hi if end == hi else None

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree."""
        parts = [b"".join(map(self.bytes_of.__getitem__, ids[k : k + 1024])) for k in range(0, len(ids), 1024)]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def _plain(ch: str) -> bool:
    """False for the control characters that Python calls space and the pattern's library does not."""
    return not "\x1c" <= ch <= "\x1f"


_loaded: dict[tuple, TreeBpe] = {}


def loaded(path: str, pattern: str) -> TreeBpe:
    if (path, pattern) not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = TreeBpe(ranks, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text and, if asked for, ids (array of int).

    A null or empty text has no tokens: the digests are those of nothing. Repeated rows give repeated results; no rows
    give none. ``path`` names a rank file that every executor can open.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(path, pattern)
        for b in batches:
            n, x, y, kept = [], [], [], []
            for k in range(b.num_rows):
                got = t.encode(b.column(1)[k].as_py() or "")
                n.append(len(got))
                x.append(hashlib.sha256(" ".join(map(t.names.__getitem__, got)).encode()).hexdigest())
                y.append(hashlib.sha256(t.decode(got)).hexdigest())
                if ids:
                    kept.append(got)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(of, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text, bytes that are no UTF-8 the replacement character."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(path, pattern)
        for b in batches:
            texts = [t.decode(b.column(1)[k].as_py() or []).decode("utf-8", "replace") for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    d = pick(encoded, "doc_id", "ids").select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return d.mapInArrow(of, "doc_id long, text string")
