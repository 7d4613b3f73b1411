"""Near-duplicate vectors by spherical-cap filters with random product codes.

A vector, rotated at random, is cut into blocks; each block has a small random code, and
a filter direction is one code word per block.  A direction's inner product with the
vector is the sum of its words'; all directions above a threshold are listed block by
block, by what each word falls short of the block's best, without visiting the others.
Vectors that share a direction are compared exactly.  Found links make components; within
each, all pairs are compared block by block to count links, so a pair costs one comparison
however many directions it shares, and no pair becomes a row.

Blocks follow the dimension and code words the number of vectors, so neither the
directions that a vector exceeds nor the vectors of a direction grow with either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import components, lean, materialize, table
from .wordhash import mix

#: Blocks at most, components of a block at least, words of a block's code at most.
BLOCKS, WIDTH, WORDS = 4, 4, 4096
#: Directions that a random vector exceeds, on average, in each of so many independent codes,
#: and directions of a code for each vector of the table.
LISTED, CODES, SPREAD = 14, 2, 4
#: Vectors of one side of a comparison, and of a part of it that is multiplied at once.
CELL, PANEL = 2048, 512


class ProductCode:
    """Filter directions for vectors of one dimension, about SPREAD for each of ``many``."""

    def __init__(self, dim: int, many: int, seed: int = 0):
        blocks = max(1, min(BLOCKS, dim // WIDTH))
        self.parts = np.array_split(np.arange(dim), blocks)
        # low dimensions can't tell more directions apart without caps narrower than a link
        wanted = min(SPREAD * max(1024, many), 2 * 8 ** min(dim, 20), 2 ** min(60.0, 6 + 1.4 * dim))
        self.words = max(2, min(WORDS, round(wanted ** (1 / blocks))))
        r = np.random.default_rng([11, seed, dim])
        self.turn = np.linalg.qr(r.standard_normal((dim, dim)))[0]
        self.code = []
        for p in self.parts:
            w = r.standard_normal((self.words, len(p)))
            self.code.append((w / np.linalg.norm(w, axis=1, keepdims=True)).T)
        # what a direction may fall short of the best one, so that LISTED pass on average
        probe = r.standard_normal((256, dim))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        size = lambda slack: len(self.decode(probe, slack)[0]) / len(probe)
        low, high = 0.0, 0.002
        while high < 1 and size(high) < LISTED:
            low, high = high, 2 * high
        for _ in range(10):
            middle = (low + high) / 2
            low, high = (low, middle) if size(middle) > LISTED else (middle, high)
        self.slack = (low + high) / 2

    def decode(self, unit: np.ndarray, slack: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of the directions that each row exceeds, row by row."""
        x = unit @ self.turn
        scores = [x[:, p] @ w for p, w in zip(self.parts, self.code, strict=True)]
        best = [s.max(axis=1) for s in scores]
        room = (self.slack if slack is None else slack) * sum(best) + 1e-12
        row, short, way = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), dtype=np.int64)
        for s, top in zip(scores, best, strict=True):
            gap = top[:, None] - s
            r, w = np.nonzero(gap <= room[:, None])
            gap = gap[r, w]
            count = np.bincount(r, minlength=len(x))
            first = np.cumsum(count) - count
            n = count[row]  # every listed beginning with each fitting word
            at = np.repeat(np.arange(len(row)), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[row][at]
            total = short[at] + gap[k]
            fits = total <= room[row[at]]
            way, short, row = way[at][fits] * self.words + w[k[fits]], total[fits], row[at[fits]]
        return row, way


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors of an array column whose lists have one length; scaled first, so no square is out of range."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _filters(many: int):
    """Rows (label, node, dim, embedding) to (key, node): one for each direction a vector exceeds."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[int, int], ProductCode] = {}
        for batch in batches:
            label, node, dims = (batch.column(i).to_numpy() for i in range(3))
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                for c in range(CODES):
                    if (dim, c) not in codes:
                        codes[dim, c] = ProductCode(dim, many, c)
                    for k in range(0, len(rows), PANEL):
                        some = rows[k : k + PANEL]
                        at, way = codes[dim, c].decode(_units(batch.column(3).take(pa.array(some))))
                        with np.errstate(over="ignore"):
                            key = mix(mix(label[some[at]].astype(np.uint64) * np.uint64(CODES) + np.uint64(c)) + np.uint64(dim) ^ mix(way.astype(np.uint64)))
                        yield pa.record_batch([pa.array(key.astype(np.int64)), pa.array(node[some[at]])], schema=schema)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in parts that hold all rows of each of their keys (the first column)."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
        if last or rest and key[0] != rest[-1].column(0)[-1].as_py():
            if not last:
                yield pa.Table.from_batches(rest)
                rest = [batch]
                continue
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
            rest = [batch.slice(last)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _near(t: pa.Table, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of linked rows (key, label, dim, side, ..., embedding) of one key, label
    and dimension, not of one side where the key is a cell of two (side 0 or 1; -1: a cell of one).
    Small runs are compared by their rows' distance, all runs at once, long ones panel by panel."""
    key, label, dim, side = (t.column(i).to_numpy() for i in range(4))
    order = np.lexsort((label, dim, key)) if (label[1:] != label[:-1]).any() or (dim[1:] != dim[:-1]).any() else np.arange(len(key))
    for d in np.unique(dim).tolist():
        rows = order[dim[order] == d]
        x = _units(t.column(t.num_columns - 1).take(pa.array(rows)))
        k, s = key[rows], side[rows]
        new = np.append(True, (k[1:] != k[:-1]) | (label[rows][1:] != label[rows][:-1]))
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        begin = np.flatnonzero(new)
        small = (size <= 24)[run]
        for step in range(1, 24):
            i = np.flatnonzero(small[:-step] & (run[step:] == run[:-step])) if len(run) > step else np.empty(0, np.int64)
            if not len(i):
                break
            i = i[(s[i] < 0) | (s[i] != s[i + step])]
            for at in range(0, len(i), 1 << 15):
                a = i[at : at + (1 << 15)]
                hit = a[np.einsum("nd,nd->n", x[a], x[a + step]) >= limit]
                if len(hit):
                    yield rows[hit], rows[hit + step]
        for r in np.flatnonzero(size > 24).tolist():
            a, b = int(begin[r]), int(begin[r] + size[r])
            for i in range(a, b, PANEL):
                for j in range(i, b, PANEL):
                    y, z = slice(i, min(i + PANEL, b)), slice(j, min(j + PANEL, b))
                    hit = x[y] @ x[z].T >= limit
                    if i == j:
                        hit = np.triu(hit, 1)
                    if s[a] >= 0:
                        hit &= s[y][:, None] != s[z][None, :]
                    p, q = np.nonzero(hit)
                    if len(p):
                        yield rows[i + p], rows[j + q]


def _stars(limit: float):
    """Rows (key, label, dim, side, node, embedding) sorted by key: links of each key's components to their least place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            node = t.column(4).to_numpy()
            root = np.arange(len(node))
            for i, j in _near(t, limit):
                while True:  # hook the roots of linked rows until none differ
                    a, b = root[i], root[j]
                    open_ = a != b
                    if not open_.any():
                        break
                    i, j, a, b = i[open_], j[open_], a[open_], b[open_]
                    np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                    while (root[root] != root).any():
                        root = root[root]
            away = np.flatnonzero(root != np.arange(len(node)))
            if len(away):
                yield pa.record_batch([pa.array(node[away]), pa.array(node[root[away]])], names=["a", "b"])

    return run


def _counted(limit: float):
    """Rows (key, label, dim, side, node, copies, embedding): copies linked with each node over the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            node, copies = t.column(4).to_numpy(), t.column(5).to_numpy()
            n = np.zeros(len(node), dtype=np.int64)
            for i, j in _near(t, limit):
                n += np.bincount(i, copies[j], len(n)).astype(np.int64) + np.bincount(j, copies[i], len(n)).astype(np.int64)
            some = np.flatnonzero(n)
            if len(some):
                yield pa.record_batch([pa.array(node[some]), pa.array(n[some])], names=["node", "n"])

    return run


def _cells(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, cells, node, ...) once for each cell they take part in: every two parts of a long
    key meet in one cell, each part with itself in one (side -1)."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    cell = F.when(F.col("cells") == 1, F.col(key)).otherwise(F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")))
    return rows.withColumn("side", side).withColumn("key", cell)


def vector_classes(vectors: DataFrame, limit: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors are compared if their labels are equal and not null and their dimensions equal.
    Null and zero vectors and those with null or non-finite parts link with nothing and are
    components of their own.  Equal vectors link.  A null id links with nothing.  What links
    are rows: those that repeat an id with the same vector count as linked copies, those that
    repeat it with another vector have that vector's links and component.  Other columns are
    ignored; an empty table gives no rows.
    """
    single = "float" in dict(vectors.dtypes)[vector_col]
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    keys = (F.xxhash64("label", "embedding").alias("h"), F.xxhash64("embedding", "label", F.lit(5)).alias("g"))
    rows = materialize(rows.withColumn("fine", fine).select("*", *keys), "vectors")
    classes = rows.where("fine").groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "classes")

    ways = materialize(classes.select("label", "node", "dim", "embedding").mapInArrow(lean(_filters(classes.count())), "key long, node long"), "ways")
    met = ways.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = materialize(met.select("key", F.ceil(F.col("m") / CELL).cast("int").alias("cells")), "met")
    rows_of = _cells(ways.join(met, "key"), "key").select("key", "side", "node")
    rows_of = rows_of.join(classes.select("node", "label", "dim", "embedding"), "node").select("key", "label", "dim", "side", "node", "embedding")
    stars = rows_of.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_stars(limit)), "a long, b long")
    grouped = materialize(components(stars.distinct()), "grouped")

    sized = materialize(grouped.groupBy("component").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells")), "sized")
    inside = _cells(grouped.join(sized, "component"), "component").select("key", "side", "node")
    inside = inside.join(classes.select("node", "label", "dim", "copies", "embedding"), "node").select("key", "label", "dim", "side", "node", "copies", "embedding")
    counted = inside.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_counted(limit)), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))

    least = grouped.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    known = classes.select("h", "g", "node", "rep", "copies").join(counted, "node", "left").join(grouped, "node", "left").join(least, "component", "left").where("copies > 1 or component is not null")
    known = materialize(known.select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"), F.lit(True).alias("fine")), "known")
    out = rows.select("vec_id", "h", "g", "fine").join(known, ["h", "g", "fine"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_cap_filters(spark, sf_dir: str) -> DataFrame:
    return vector_classes(table(spark, sf_dir, "embeddings"))


#: Quadratic in SQL; tested against brute force.
QUERIES, ORACLES = {"op5_cap_filters": op5_cap_filters}, {}
