"""The parts of the similarity join that whole runs on small tables don't reach."""

import tracemalloc

import numpy as np
import pyarrow as pa

from folioscope.llm import jaccard_join
from tests.llm.test_operators import check_jaccard


def lists(classes, tokens, chunks=8):
    """Token names with the entries (class, size, remaining) of their lists."""
    batch = pa.record_batch([pa.array(classes, pa.int64()), pa.array([9] * len(classes), pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["c", "n", "prefix"])
    owned = pa.Table.from_batches(list(jaccard_join._owned(chunks)([batch]))).sort_by("chunk").to_batches()
    out = {}
    for b in jaccard_join._posted(iter(owned)):
        for t, c, n, r, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out.setdefault(t, []).append((c, n, r, m))
    return out


def test_classes_of_equal_halves_are_two():
    """Classes whose hashes agree in the upper or the lower 32 bits still share tokens."""
    tokens = [[5, 1 << 40, -7], [1 << 40, 5, 99]]
    first, second = jaccard_join._place(np.array([5, 1 << 40], dtype=np.int64).view(np.uint64), 8).tolist()
    for a, b in (((7 << 32) | 1, (7 << 32) | 2), (1, (9 << 32) | 1), (-2, -1)):
        assert lists([a, b], tokens) == {first: [(a, 9, 9, 2), (b, 9, 8, 2)], second: [(a, 9, 8, 2), (b, 9, 9, 2)]}
    assert lists([3, 3], tokens) == {}
    assert lists([3, 3, 4], [[8, 5], [5], [5]])[first] == [(3, 9, 9, 2), (4, 9, 9, 2)]


def test_hot_leader_is_spread(spark, monkeypatch):
    """With parts of a few members and short lists the answer stays the same."""
    import random

    for name, value in (("MEMBERS", 3), ("CELL", 4), ("BLOCK", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    r = random.Random(5)
    texts = []
    for c in range(4):
        w = [f"c{c}w{k}" for k in range(60)]
        for _ in range(25):
            v = list(w)
            for _ in range(r.randrange(1, 4)):
                v[r.randrange(60)] = f"z{r.randrange(10**6)}"
            texts += [" ".join(v)] * r.choice([1, 1, 3])
    check_jaccard(spark, texts)


def test_full_maps_lose_nothing(spark, monkeypatch):
    """Maps far too small for what they hold let more through, and what passes is sorted out by a join."""
    for name, value in (("LEAST_BITS", 1 << 15), ("MOST_BITS", 1 << 15), ("BUCKETS", 1 << 12)):
        monkeypatch.setattr(jaccard_join, name, value)
    texts = [" ".join(f"a{(i // 3) * 7 + k}" for k in range(40 - i % 3)) for i in range(400)]
    check_jaccard(spark, texts)


def test_pairs_of_hot_lists_go_on():
    """A batch of ten full cells makes millions of pairs, of which a task holds a bounded number."""
    n = 1000
    columns = [np.repeat(np.arange(10), n), np.zeros(10 * n, np.int64), np.tile(np.arange(n), 10), np.full(10 * n, 9), np.full(10 * n, 9)]
    batch = pa.record_batch([pa.array(c) for c in columns], names=["token", "cell", "c", "n", "r"])
    tracemalloc.start()
    got = [len(b) for b in jaccard_join._lists(85, 100)([batch])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(got) >= n * (n - 1) // 2 and peak < 60 << 20
    found = {p for b in jaccard_join._lists(85, 100)([batch.slice(0, n)]) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert len(found) == n * (n - 1) // 2 and all(a < b for a, b in found)
