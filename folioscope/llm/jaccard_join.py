"""Exact Jaccard self-join on word shingles, with skipping by set relations.

1. One pass over the texts gives each set a fingerprint, some minimum hashes and its
   share of a fixed-size table of token counts.  Equal sets are one class from here on.
2. Answer-level skipping: classes that agree in several minimum hashes with a more
   copied class take it as *leader* once the exact similarity is verified.  Later, a
   leader's computed answers stand for its members': by the triangle inequality of the
   Jaccard distance a member can only link where its leader is near.
3. Index-level skipping: each set's rarest tokens (by the counts, ties by hash) are its
   prefix; a token's index list has one entry per leader and set size with the largest
   number of remaining tokens.  Lists are sorted by size, cut in blocks, and a block is
   skipped by its largest remainder or sizes before any of its entries is looked at.
4. Leader pairs out of the lists are verified on whole sets.  Near leaders that don't
   link themselves have their members compared block by block.

The result is exact but for collisions of 64-bit hashes: no candidate or list is capped,
long lists are split into cells of bounded size and every pair of cells is visited.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import ROW, bucketed, components, lean, materialize, numbered, table, without
from .wordhash import Shingler, Words, mix

SPACES = {32, 9, 10, 11, 12, 13}
#: Least and largest size of the token count table (8 bytes each where it is used), and of a part of it that is sent.
BUCKETS, MOST_BUCKETS, CHUNK = 1 << 18, 1 << 23, 1 << 12
MINHASHES, AGREE = 6, 3
#: Least and most bits of a map of ids, and of each id: what passes by chance is work, never a result.
LEAST_BITS, MOST_BITS, ID_BITS = 1 << 23, 1 << 28, 64
#: Prefix entries of one part of the token space, which a task holds at once.
CHUNK_ENTRIES = 1 << 21
#: Entries of a cell of a long index list, and of a block within it.
CELL, BLOCK = 1024, 64
#: Pairs out of the lists that a task holds before it gives them on.
PAIRS = 1 << 18
#: Tokens for each part of the token space; the parts' counts bound the overlap of two sets before they meet.
PER_BIN, LEAST_BINS = 4, 64
#: Sets of either side of a comparison of members, or of a hub's partners, in one task.
MEMBERS = 256


def _need(nx, nz, num: int, den: int):
    """Least overlap of sets of these sizes at Jaccard num/den."""
    return -(-num * (nx + nz) // (num + den))


def _shingler(size: int) -> Shingler:
    return Shingler(size, Words(SPACES))


def _print(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _buckets(docs: DataFrame) -> int:
    """Counters by the size of the input as the plan estimates it, if it does: 2 ** 18 up to some GB, then in proportion."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # a plan without figures
        return BUCKETS
    return min(MOST_BUCKETS, max(BUCKETS, 1 << (size >> 15).bit_length()))


def _scan(size: int, buckets: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("mins", pa.list_(pa.int64())), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, counts = _shingler(size), np.zeros(buckets, dtype=np.int64)
        odd = np.array([2 * k + 1 for k in range(MINHASHES)], dtype=np.uint64)[:, None]
        for batch in batches:
            if not batch.num_rows:
                continue
            n, f1, f2, mins = [], [], [], []
            with np.errstate(over="ignore"):
                for _, s, _ in sh.sets(batch.column(1)):
                    n.append(len(s))
                    a, b = _print(s)
                    f1.append(a)
                    f2.append(b)
                    counts += np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) if len(s) > buckets // 8 else 0
                    if 0 < len(s) <= buckets // 8:
                        np.add.at(counts, (s & np.uint64(buckets - 1)).astype(np.int64), 1)
                    mins.append(mix(s[None, :] * odd + odd).min(axis=1).astype(np.int64) if len(s) else np.empty(0, np.int64))
            none = pa.nulls(len(n))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(mins, pa.list_(pa.int64())), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if counts.any():
            k = buckets // CHUNK
            none = pa.nulls(k)
            packed = [zlib.compress(counts[i * CHUNK : (i + 1) * CHUNK].tobytes(), 1) for i in range(k)]
            yield pa.record_batch([none.cast(pa.int64())] * 4 + [none.cast(pa.list_(pa.int64())), pa.array(range(k), pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the count tables of a partition, chunk by chunk."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(packed), dtype=np.int64)
            sums[chunk] = sums[chunk] + part if chunk in sums else part
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["chunk", "counts"])


def _holds(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids (signed) the bitmap holds, without unpacking it."""
    at = ids % (8 * len(packed))
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _bits(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap, sized by their number, that holds at least the given 64-bit ids."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (ID_BITS * ids.count()).bit_length()))
    where = F.pmod(F.col(column), F.lit(bits)) + 1  # bucket b begins at (b - 1) * 32768 + 1
    got = ids.select(F.bitmap_bucket_number(where).alias("b"), F.bitmap_bit_position(where).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for b, m in got.toLocalIterator():  # at most bits / 32768 rows
        part = np.packbits(np.unpackbits(np.frombuffer(bytes(m), dtype=np.uint8), bitorder="little"))
        at = (b - 1) * 4096
        out[at : at + len(part)] |= part[: max(0, len(out) - at)]
    return out


def _emit(size: int, num: int, den: int, counts: np.ndarray | None, wanted: np.ndarray):
    """Rows (f1, n, prefix, bins, items): prefix and bins if counts are given, items of wanted sets."""
    schema = pa.schema([("f1", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("bins", pa.binary()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, seen = _shingler(size), set()

        def flush(rows):
            return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            rows, held = [], 0
            for _, s, _ in sh.sets(batch.column(0)):
                if not len(s):
                    continue
                f1, _f2 = _print(s)
                if f1 in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(f1)
                prefix = bins = None
                if counts is not None:
                    bins = _bins(s)
                    p = len(s) - -(-num * len(s) // den) + 1
                    c = counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]
                    prefix = s[np.lexsort((s, c))[:p]].astype(np.int64)
                items = s.tobytes() if _holds(wanted, np.array([f1]))[0] else None
                if prefix is None and items is None:
                    continue
                rows.append((f1, len(s), prefix, bins, items))
                held += 8 * ((0 if prefix is None else len(prefix)) + (len(s) if items else 0))
                if held > 4 << 20:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)

    return run


def _n_bins(n: int) -> int:
    return max(LEAST_BINS, 1 << (-(-n // PER_BIN) - 1).bit_length())


def _bins(s: np.ndarray) -> bytes:
    """How many tokens have each value of their top bits: their sums of minima bound overlaps."""
    k = _n_bins(len(s))
    n = np.bincount((s >> np.uint64(65 - k.bit_length())).astype(np.int64), minlength=k)
    return n.astype(np.uint8 if n.max() < 256 else np.uint32).tobytes()


def _counts_of(bins: bytes, n: int, k: int) -> np.ndarray:
    """The counts of a set of n tokens in k parts, as many as its own or fewer."""
    own = np.frombuffer(bins, dtype=np.uint8 if len(bins) == _n_bins(n) else np.uint32)
    return own.reshape(k, -1).sum(axis=1, dtype=np.int64)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, limit, na, nb, bins of a, bins of b): pairs whose overlap can reach Jaccard 1 - limit."""
    for batch in batches:
        if not batch.num_rows:
            continue
        limit, na, nb = (batch.column(i).to_numpy() for i in (2, 3, 4))
        most = np.empty(batch.num_rows, dtype=np.int64)
        for i, (x, y) in enumerate(zip(batch.column(5), batch.column(6), strict=True)):
            k = _n_bins(int(min(na[i], nb[i])))
            most[i] = np.minimum(_counts_of(x.as_py(), int(na[i]), k), _counts_of(y.as_py(), int(nb[i]), k)).sum()
        fits = most + 1e-6 >= (1 - limit) * (na + nb - most)
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fits))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, row and position of each prefix token of rows (c, n, prefix)."""
    listed = batch.column(2)
    token = listed.flatten().to_numpy()
    count = np.diff(listed.offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), count)
    return token, row, np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)


def _planes(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones, and so on: like bytes compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _place(token: np.ndarray, chunks: int) -> np.ndarray:
    """A token's name: its part of the token space, by its upper half, and its lower half.  Tokens of
    one name have one list, so a name that two share costs comparisons only."""
    chunk = ((token >> np.uint64(32)) * np.uint64(chunks)) >> np.uint64(32)
    return chunk << np.uint64(32) | token & np.uint64(0xFFFFFFFF)


def _best(name: np.ndarray, owner: np.ndarray, n: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries sorted by token, class and size, of equal ones the one with the most remaining tokens."""
    order = np.lexsort((~r, n, owner, name))
    name, owner, n, r = name[order], owner[order], n[order], r[order]
    new = np.ones(len(name), dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1]) | (n[1:] != n[:-1])
    return name[new], owner[new], n[new], r[new]


def _owned(chunks: int):
    """Rows (c, n, prefix) to (chunk, data): by parts of the token space, the low 32 bits of each
    token as steps, its class, the set's size and remaining tokens, sorted."""
    schema = pa.schema([("chunk", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            token, row, pos = _flat(batch)
            name = _place(token.view(np.uint64), chunks)
            n = batch.column(1).to_numpy()[row]
            name, owner, n, r = _best(name, batch.column(0).to_numpy()[row], n.astype(np.uint32), (n - pos).astype(np.uint32))
            edge = np.searchsorted(name >> np.uint64(32), np.arange(chunks + 1, dtype=np.uint64))
            some = np.flatnonzero(edge[1:] > edge[:-1])
            low = name.astype(np.uint32)
            data = [_planes(np.diff(low[x], prepend=np.uint32(0))) + owner[x].tobytes() + _planes(n[x]) + _planes(r[x]) for x in (slice(edge[k], edge[k + 1]) for k in some)]
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array(data, pa.binary())], schema=schema)

    return run


def _unplanes(data: bytes, at: int, k: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * k, at).reshape(4, k).T).view(np.uint32).ravel()


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, data) sorted by chunk to (token, c, n, r, m): the index lists of tokens that several
    classes have, each entry with how many its list has.  Most tokens are one class's and end here."""
    parts: list[bytes] = []

    def done(chunk: int) -> Iterator[pa.RecordBatch]:
        token, owner, n, r = [], [], [], []
        for p in parts:
            k = len(p) // 20
            token.append(np.cumsum(_unplanes(p, 0, k), dtype=np.uint32))
            owner.append(np.frombuffer(p, np.int64, k, 4 * k))
            n.append(_unplanes(p, 12 * k, k))
            r.append(_unplanes(p, 16 * k, k))
        parts.clear()
        token, owner, n, r = _best(*map(np.concatenate, (token, owner, n, r)))
        at = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        end = np.append(at[1:], len(token))
        size = end - at
        keep = np.repeat(owner[at] != owner[end - 1], size)
        m = np.repeat(size, size)[keep]
        token = token[keep].astype(np.int64) | np.int64(chunk) << np.int64(32)
        columns = [token, owner[keep], n[keep].astype(np.int64), r[keep].astype(np.int64), m.astype(np.int64)]
        for i in range(0, len(token), 1 << 17):
            yield pa.record_batch([pa.array(c[i : i + (1 << 17)]) for c in columns], names=["token", "c", "n", "r", "m"])

    chunk = None
    for batch in batches:
        for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != chunk and parts:
                yield from done(chunk)
            chunk = k
            parts.append(p)
    if parts:
        yield from done(chunk)


def _lists(num: int, den: int):
    """Candidate pairs (a, b) from index lists: rows (token, cell, c, n, r) sorted by token, cell, n."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(c: np.ndarray, n: np.ndarray, r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edge = np.arange(0, len(c), BLOCK)
        top = np.maximum.reduceat(r, edge)
        small, large = n[edge], n[np.append(edge[1:] - 1, len(n) - 1)]
        for i in range(len(edge)):
            x = slice(edge[i], edge[i] + BLOCK)
            for j in range(i, len(edge)):
                if den * large[i] < num * small[j]:
                    break  # sizes ascend
                need = _need(small[i], small[j], num, den)
                if top[i] < need or top[j] < need:
                    continue
                y = slice(edge[j], edge[j] + BLOCK)
                ok = np.minimum(r[x][:, None], r[y][None, :]) >= _need(n[x][:, None], n[y][None, :], num, den)
                ok &= c[x][:, None] != c[y][None, :]
                a, b = np.nonzero(ok)
                if len(a):
                    a, b = c[x][a], c[y][b]
                    yield np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        out: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal held
            held = 0
            both = np.unique(np.concatenate(out, axis=1), axis=1)
            out.clear()
            return pa.record_batch([pa.array(both[0]), pa.array(both[1])], schema=schema)

        def groups(block):
            key = (block[0][1:] != block[0][:-1]) | (block[1][1:] != block[1][:-1])
            return np.concatenate(([0], np.flatnonzero(key) + 1, [len(block[0])]))

        def take(block, cuts):
            nonlocal held
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    for x, y in pairs(block[2][a:b], block[3][a:b], block[4][a:b]):
                        out.append(np.stack([x, y]))
                        held += len(x)
                        if held >= PAIRS:
                            yield flush()

        for batch in batches:
            if not batch.num_rows:
                continue
            block = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if rest is not None:
                block = [np.concatenate(x) for x in zip(rest, block, strict=True)]
            cuts = groups(block)
            yield from take(block, cuts[:-1])
            rest = [x[cuts[-2] :] for x in block]
            if held > 100_000:
                yield flush()
        if rest is not None:
            yield from take(rest, groups(rest))
        if out:
            yield flush()

    return run


def _overlaps(limit: float):
    """Rows (key, role, id, items) sorted by key and role: roles 0 are held, each role 1 is
    compared with them.  Gives (a, b, d): held, compared, Jaccard distance up to limit."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64()), ("links", pa.bool_())])

    def factory(num: int, den: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []
            for batch in batches:
                out = []
                for k, role, f, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if k != key:
                        key, held = k, []
                    s = np.frombuffer(items, dtype=np.uint64)
                    if role == 0:
                        held.append((f, s))
                        continue
                    for g, h in held:
                        if g == f or den * min(len(s), len(h)) < num * max(len(s), len(h)) and limit <= 1 - num / den:
                            continue
                        small, big = (s, h) if len(s) <= len(h) else (h, s)
                        at = np.searchsorted(big, small)
                        at[at == len(big)] = 0
                        o = int((big[at] == small).sum())
                        union = len(s) + len(h) - o
                        if 1 - o / union <= limit + 1e-12:
                            out.append((g, f, 1 - o / union, den * o >= num * union))
                if out:
                    a, b, d, links = zip(*out, strict=True)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64()), pa.array(links, pa.bool_())], schema=schema)

        return run

    return factory


def _compare(rows: DataFrame, num: int, den: int, limit: float) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "role").mapInArrow(lean(_overlaps(limit)(num, den)), "a long, b long, d double, links boolean")


def _with_items(rows: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(key, role, f1) with the sets out of tables filed by f1."""
    found = [rows.join(t, "f1").select("key", "role", "f1", "items") for t in tables]
    return functools.reduce(DataFrame.unionByName, found)


def _verify(pairs: DataFrame, tables: list[DataFrame], num: int, den: int, limit: float) -> DataFrame:
    """Exact distances of (a, b) pairs up to limit; a hub's partners are dealt over blocks."""
    sized = materialize(pairs.groupBy("a").agg(F.count("*").alias("m")), "hubs")
    salt = lambda c: F.pmod(F.xxhash64(c), F.greatest(F.lit(1), F.ceil(F.col("m") / MEMBERS)))
    key = F.xxhash64("a", "k")
    keyed = materialize(pairs.join(sized, "a").select("a", "b", salt("b").alias("k")), "keyed")
    hubs = keyed.select("a", "k").distinct().select(key.alias("key"), F.lit(0).alias("role"), F.col("a").alias("f1"))
    probes = keyed.select(key.alias("key"), F.lit(1).alias("role"), F.col("b").alias("f1"))
    return _compare(_with_items(hubs.unionByName(probes), tables), num, den, limit)


def jaccard_classes(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two texts link when ``den * |A and B| >= num * |A or B|`` for their sets of distinct
    ``size``-word shingles (words: runs without ASCII white space, A-Z lower-cased).
    A text with fewer words has its whole sequence as one shingle.  Null, empty and blank
    texts have an empty set and link with nothing.  Equal texts link; repeated rows stay
    repeated; a null id gives a row whose component is that of its set's other rows, or
    null.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = _buckets(texts)
    scan = materialize(texts.mapInArrow(lean(_scan(size, buckets)), "doc_id long, n long, f1 long, f2 long, mins array<long>, chunk int, counts binary"), "scan")
    added = scan.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(lean(_added), "chunk int, counts binary")
    counts = np.zeros(buckets, dtype=np.int64)
    for chunk, packed in added.toLocalIterator():  # buckets / CHUNK rows of CHUNK counts
        counts[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(bytes(packed)), dtype=np.int64)

    known = scan.where("chunk is null")
    classes = materialize(known.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("mins").alias("mins")), "classes")

    # leaders: of the classes with one minimum hash, the most copied
    signed = classes.select("f1", "copies", F.posexplode("mins").alias("j", "h"))
    heads = signed.groupBy("j", "h").agg(F.max(F.struct("copies", "f1")).alias("top"), F.count("*").alias("m")).where("m > 1")
    heads = materialize(heads.select("j", "h", F.col("top.f1").alias("a")), "heads")
    tried = signed.join(heads, ["j", "h"]).where("f1 <> a").groupBy("a", F.col("f1").alias("b")).agg(F.count("*").alias("agree"))
    tried = materialize(tried.where(F.col("agree") >= AGREE).select("a", "b"), "tried")
    wanted = _bits(tried.select("a").union(tried.select("b")), "a")

    kept = materialize(texts.select("text").mapInArrow(lean(_emit(size, num, den, counts, wanted)), "f1 long, n long, prefix array<long>, bins binary, items binary"), "kept")
    sets = bucketed(kept.where("items is not null").select("f1", "items").groupBy("f1").agg(F.first("items").alias("items")), "f1", "sets")
    near = materialize(_verify(tried, [sets], num, den, 1 - num / den), "near").where("links")
    roots = near.join(near.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    led = materialize(roots.groupBy("b").agg(F.min(F.struct("d", "a")).alias("best")).select("b", F.col("best.a").alias("leader"), F.col("best.d").alias("d")), "led")

    # index lists: one entry per token, leader and size; only a set that was tried can have a leader
    listed = kept.where("prefix is not null")
    members = listed.where("items is not null").select("f1", "n", "prefix").join(led.select(F.col("b").alias("f1"), "leader"), "f1", "left")
    prefixes = listed.where("items is null").select(F.col("f1").alias("c"), "n", "prefix")
    prefixes = materialize(prefixes.unionByName(members.select(F.coalesce("leader", "f1").alias("c"), "n", "prefix")), "prefixes")
    # by parts of the token space, of which no task holds more than a bounded number of entries
    entries = prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    chunks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // CHUNK_ENTRIES))
    owned = prefixes.mapInArrow(lean(_owned(chunks)), "chunk int, data binary").repartition("chunk").sortWithinPartitions("chunk")
    posted = materialize(owned.mapInArrow(lean(_posted), "token long, c long, n long, r long, m long"), "posted")
    # a list longer than a cell is cut, and every two of its cells meet
    cells = F.ceil(F.col("m") / CELL).cast("int")
    entries = posted.withColumn("cells", cells).withColumn("own", F.pmod(F.xxhash64("c"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    entries = entries.select("token", (F.least("own", "other") * F.col("cells") + F.greatest("own", "other")).cast("long").alias("cell"), "c", "n", "r")
    met = entries.repartition("token", "cell").sortWithinPartitions("token", "cell", "n").mapInArrow(lean(_lists(num, den)), "a long, b long")
    far = 1 - num / den
    radius = led.groupBy(F.col("leader").alias("l")).agg(F.max("d").alias("radius"))
    bins = materialize(kept.where("bins is not null").groupBy("f1").agg(F.first("n").alias("n"), F.first("bins").alias("bins")).join(radius, F.col("f1") == radius.l, "left").select("f1", "n", "bins", F.coalesce("radius", F.lit(0.0)).alias("radius")), "bins")
    met = materialize(met.distinct(), "candidates")
    met = met.join(bins.select(F.col("f1").alias("a"), F.col("n").alias("na"), F.col("bins").alias("xa"), F.col("radius").alias("ra")), "a")
    met = met.join(bins.select(F.col("f1").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("xb"), F.col("radius").alias("rb")), "b")
    met = met.select("a", "b", (far + F.col("ra") + F.col("rb")).alias("limit"), "na", "nb", "xa", "xb")
    met = materialize(met.mapInArrow(lean(_bounded), "a long, b long"), "met")

    # exact distances between leaders; up to three limits apart their members may link
    have = [sets]
    ids = met.select("a").union(met.select("b")).distinct()
    more = ids.join(sets.select(F.col("f1").alias("a")), "a", "left_anti")
    wanted = _bits(more, "a")
    if wanted.any():
        extra = texts.select("text").mapInArrow(lean(_emit(size, num, den, None, wanted)), "f1 long, n long, prefix array<long>, bins binary, items binary")
        extra = extra.select("f1", "items").join(sets.select("f1"), "f1", "left_anti").groupBy("f1").agg(F.first("items").alias("items"))
        have.append(bucketed(extra, "f1", "more"))
    pairs = materialize(_verify(met, have, num, den, 3 * far), "pairs")
    links = near.select("a", "b").unionByName(pairs.where("links").select("a", "b"))

    # members near another leader that their own doesn't link with
    size_of = led.groupBy(F.col("leader").alias("a")).agg(F.max("d").alias("radius"), F.count("*").alias("m"))
    both = pairs.where("not links").select("a", "b", "d").unionByName(pairs.where("not links").select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    both = both.join(size_of, "a").join(size_of.select(F.col("a").alias("b"), F.col("radius").alias("other"), F.col("m").alias("m2")), "b", "left")
    both = both.where(F.col("d") - F.col("radius") - F.coalesce("other", F.lit(0.0)) <= far + 1e-9)
    both = both.where(F.col("m2").isNull() | (F.col("m") > F.col("m2")) | (F.col("m") == F.col("m2")) & (F.col("a") < F.col("b")))
    both = materialize(both.select("a", "b", "d", "radius", (F.col("d") - F.coalesce("other", F.lit(0.0))).alias("reach"), F.ceil(F.col("m") / MEMBERS).cast("int").alias("blocks")), "both")
    if both.take(1):
        probes = both.select("a", F.col("b").alias("p"), "blocks").unionByName(both.join(led.withColumnRenamed("b", "p"), both.b == F.col("leader")).where(both.d - both.radius - led.d <= far + 1e-9).select("a", "p", "blocks"))
        probes = materialize(probes.distinct(), "probes")
        # both sides of a leader's comparison are cut, and every two of their parts meet
        parts = probes.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
        probes = probes.join(parts, "a").withColumn("j", F.pmod(F.xxhash64("p", F.lit(3)), F.col("parts")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        hubs = both.groupBy("a", "blocks").agg(F.min("reach").alias("reach"))
        near_by = led.select(F.col("leader").alias("a"), F.col("b").alias("p"), "d")
        hubs = hubs.join(near_by, "a").unionByName(hubs.withColumn("p", F.col("a")).withColumn("d", F.lit(0.0)))  # a leader may link with another's member
        hubs = hubs.where(F.col("reach") - F.col("d") <= far + 1e-9).withColumn("k", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int"))
        hubs = hubs.join(parts, "a").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        key = F.xxhash64("a", "k", "j").alias("key")
        rows = hubs.select(key, F.lit(0).alias("role"), F.col("p").alias("f1")).unionByName(probes.select(key, F.lit(1).alias("role"), F.col("p").alias("f1")))
        rows = _with_items(rows, have)
        links = links.unionByName(_compare(rows, num, den, far).where("links").select("a", "b"))

    rep = classes.select("f1", "rep")
    named = links.join(rep.select(F.col("f1").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("f1").alias("b"), F.col("rep").alias("y")), "b")
    joined = components(named.where("x is not null and y is not null").select(F.col("x").alias("a"), F.col("y").alias("b")))
    joined = classes.join(joined, classes.rep == joined.node, "left").where("copies > 1 or component is not null")
    joined = materialize(joined.select("f1", "f2", "n", F.coalesce("component", "rep").alias("component")), "joined")
    out = known.where("n > 0").select("doc_id", "n", "f1", "f2").join(joined, ["f1", "f2", "n"], "left")
    out = out.select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    blank = known.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))  # they'd share one key
    return out.unionByName(blank).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of linked texts: one of the smallest id, null ids last."""
    rows = numbered(docs)
    found = jaccard_classes(rows, size, num, den, id_col=ROW).where("doc_id <> component_id").select(F.col("doc_id").alias(ROW), "component_id")
    linked = materialize(found.unionByName(found.select(F.col("component_id").alias(ROW), "component_id").distinct()), "linked")
    named = materialize(linked.join(rows.select(ROW, "doc_id"), ROW), "named")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).getField(ROW).alias("kept"))
    gone = named.join(kept, "component_id").where(F.col(ROW) != F.col("kept")).select(F.col(ROW).alias("gone"))
    return without(rows, materialize(gone, "copies"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), size=4, num=85)


#: Quadratic in SQL; tested against brute force on small tables.
QUERIES, ORACLES = {"op3_jaccard_join": op3_jaccard_join}, {}
