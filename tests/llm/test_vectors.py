"""The vector filters against brute force, by dimension and on odd vectors."""

import itertools
import math

import numpy as np
import pytest

from folioscope.llm import cap_filters

KIND = "vec_id long, embedding array<double>, label int, key long, node long, h long, rep long, cells int"


def brute(rows, limit=0.98):
    """n_links and component of each row, for (id, vector, label) rows whose vectors may be compared."""
    unit = {}
    for i, (vec_id, v, label) in enumerate(rows):
        if vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            unit[i] = x / np.sqrt(x @ x)
    links, root = [0] * len(rows), list(range(len(rows)))
    for i, j in itertools.combinations(unit, 2):
        if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= limit:
            links[i] += 1
            links[j] += 1
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root) if rows[r][0] is not None}
    return sorted(((rows[i][0], links[i], least.get(root[i])) for i in range(len(rows))), key=repr)


def found(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], KIND)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in cap_filters.vector_classes(frame.repartition(3)).collect()), key=repr)


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 6, 8, 12, 16, 33, 64, 300])
def test_recall_at_the_limit(dim):
    """Pairs barely within the limit share a direction, and lists stay short at any dimension and size."""
    r = np.random.default_rng(dim)
    u = r.standard_normal((300, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    side = r.standard_normal((300, dim))
    side -= (side * u).sum(1, keepdims=True) * u
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-9)
    cos = 0.98 + 0.003 * r.random((300, 1)) if dim > 1 else np.ones((300, 1))
    v = cos * u + np.sqrt(1 - cos**2) * side
    for many in (1_000, 10**6, 10**9):
        met, listed = np.zeros(300, dtype=bool), 0
        for c in range(cap_filters.CODES):
            code = cap_filters.ProductCode(dim, many, c)
            a, b = (set(zip(*map(np.ndarray.tolist, code.decode(x)), strict=True)) for x in (u, v))
            met[[i for i, _ in a & b]] = True
            listed += len(a)
        assert met.mean() >= 0.9 and listed <= 300 * 60


def test_classes_are_exact(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((20, 16))
    rows = [(i, (base[i % 20] + 0.08 * r.standard_normal(16)).tolist(), int(i % 20 % 3)) for i in range(240)]
    rows += [(500, rows[0][1], 0), (501, None, 1), (502, [0.0] * 16, 1), (503, [float("nan")] * 16, 1), (504, rows[1][1], None), (505, [1.0, None], 1), (506, [], 1), (None, rows[1][1], 1)]
    rows += [(510, [1.0, 2.0], 1), (510, [1.0, 2.0], 1), (511, [1e200, 2e200], 1), (512, [1e-200, 2e-200], 1), (513, [float("inf"), 1.0], 1)]
    want, got = brute(rows), found(spark, rows)
    assert sum(a != b for a, b in zip(want, got, strict=True)) <= 2
    assert sum(n for _, n, _ in got) >= 0.98 * sum(n for _, n, _ in want)
    special = [x for x in want if x[0] is None or x[0] >= 500]
    assert [x for x in got if x[0] is None or x[0] >= 500] == special
    assert found(spark, []) == []


def test_repeated_ids(spark):
    """An id with two vectors joins nothing; each row has its own vector's class."""
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [0.0, 1.0, 0.01], 1), (4, [0.0, 0.0, 1.0], 1)]
    assert found(spark, rows) == brute(rows) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_long_runs_are_cut(spark, monkeypatch):
    """A direction and a component of many cells give what one gives."""
    monkeypatch.setattr(cap_filters, "CELL", 16)
    r = np.random.default_rng(4)
    rows = [(i, (np.eye(8)[0] + 0.06 * r.standard_normal(8)).tolist(), 0) for i in range(150)]
    assert found(spark, rows) == brute(rows)
