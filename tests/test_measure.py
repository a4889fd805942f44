import numpy as np
import pyarrow as pa
import pytest

from framesift.functions import measure as M
from framesift.plans import queries as Q


def _batch(pictures):
    sizes = [p.shape for p in pictures]
    return pa.RecordBatch.from_arrays([*(pa.array([s[k] for s in sizes], pa.int32()) for k in range(3)), pa.array([p.tobytes() for p in pictures], pa.binary())], ["height", "width", "channels", "data"])


@pytest.fixture
def stacks(monkeypatch):
    """The shapes of the stacks that are measured."""
    seen, of = [], M.measured_stack
    monkeypatch.setattr(M, "measured_stack", lambda x: seen.append(x.shape) or of(x))
    return seen


def test_pictures_of_one_size_are_measured_together(stacks):
    r = np.random.default_rng(0)
    pictures = [r.integers(0, 256, s, np.uint8) for _ in range(300) for s in ((16, 16, 1), (5, 9, 3), (40, 33, 4))]
    got = list(zip(*[c.to_pylist() for c in M._measured_batch(_batch(pictures))]))
    assert sorted(s[0] for s in stacks) == [102, 198, 300, 300]  # the largest size fills a stack before its end
    assert all(a == pytest.approx(b, rel=1e-12, abs=1e-12) for a, b in zip(got, map(M.measured, pictures)))


def test_a_large_picture_is_measured_alone(stacks):
    large = np.zeros((1024, 1025, 1), np.uint8)
    assert M._measured_batch(_batch([large, large]))[0].null_count == 0
    assert stacks == [(1, *large.shape)] * 2


def test_a_picture_that_is_none_has_nulls_beside_the_others():
    b = pa.RecordBatch.from_arrays([pa.array([2, 2, None, 2, 0], pa.int32()), pa.array([2] * 5, pa.int32()), pa.array([1] * 5, pa.int32()), pa.array([b"abcd", None, b"abcd", b"abc", b""], pa.binary())], ["height", "width", "channels", "data"])
    assert all(c.is_null().to_pylist() == [False, True, True, True, True] for c in M._measured_batch(b))


def test_pictures_are_drawn_from_their_numbers():
    ids = [0, None, 5, 5_999_999]
    (b,) = Q._drawn([pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["photo_id"])])
    want = [None if i is None else bytes((i * 37 + y * x * 5 + y * 11 + x * 17 + i % 7 * y * y) % 256 for y in range(16) for x in range(16)) for i in ids]
    assert b.column("photo_id").to_pylist() == ids and b.column("data").to_pylist() == want


def test_hashes_of_a_stack_are_those_of_its_pictures_alone(stacks):
    r = np.random.default_rng(1)
    pictures = [r.integers(0, 256, s, np.uint8) for _ in range(200) for s in ((16, 16, 1), (32, 45, 1), (3, 70, 3))] + [np.full((16, 16, 1), v, np.uint8) for v in (0, 7, 255)]
    high, low = (c.to_pylist() for c in M._measured_batch(_batch(pictures))[6:])
    assert len(stacks) == 3  # one a size
    assert list(zip(high, low)) == [M.perceptual_hash(M.luma(p)) for p in pictures]
    assert all(0 <= x < 1 << 32 for x in high + low)
