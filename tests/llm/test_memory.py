"""What a Python worker still holds between two tasks; it counts beside whatever runs on its executor then."""

import subprocess
import sys

import pytest

HELD = """
import re
import numpy as np, pyarrow as pa
from framesift.llm import similar, suffix_dedup as sd

class Docs:
    def select(self, *_):
        return self
    def mapInArrow(self, of, schema):
        self.of = of
        return self

def mb():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

r = np.random.default_rng(1)
words = np.array(["".join(map(chr, r.integers(97, 123, 5))) for _ in range(20_000)])

def batch(seed):
    x = np.random.default_rng(seed)
    texts = [" ".join(words[x.integers(0, len(words), 300)]) for _ in range(5_000)]
    return pa.RecordBatch.from_arrays([pa.array(range(5_000)), pa.array(np.zeros(5_000, np.int64)), pa.array(texts)], ["doc", "part", "text"])

def task(seeds):
    docs = Docs()
    WHICH
    return sum(b.num_rows for b in docs.of(map(batch, seeds)))

before = mb()
assert task(range(6))
print(mb() - before)
"""
TASKS = {
    "runs": "sd._keyed = lambda d: d; sd.Scratch = lambda s: None; docs.sparkSession = None\n    try: sd.removed_spans(docs)\n    except Exception: pass",
    "sketches": "similar._rows = lambda d: d; similar.sketches(docs)",
}


@pytest.mark.parametrize("which", TASKS)
def test_a_worker_gives_back_what_its_task_freed(which):
    out = subprocess.run([sys.executable, "-c", HELD.replace("WHICH", TASKS[which])], capture_output=True, text=True, timeout=120, env={"PYTHONPATH": ".", "OMP_NUM_THREADS": "1"})
    assert out.returncode == 0, out.stderr[-2000:]
    assert float(out.stdout) < 60
