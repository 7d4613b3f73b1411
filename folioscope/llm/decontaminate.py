"""Benchmark decontamination with a word-level FM-index per shard.

A shard's words become numbers of the benchmark's vocabulary; other words, which no
phrase contains, and ends of texts are separators.  Runs between separators that are
shorter than every phrase are left out.  Over what remains the shard gets a suffix
array (only to build the rest), its Burrows-Wheeler transform as a wavelet matrix, and
suffix positions sampled every few words and at each run's start.  All phrases are
searched backwards at once; occurrences walk to a sampled position and become spans of
words, which are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import lean, materialize, table
from .wordhash import Words, buffers

WINDOW = 10
SAMPLE = 8
#: Bytes of text indexed at once; a longer text is a shard of its own.
SHARD = 2 << 20
#: Words of benchmark text whose phrases are sent to every task; more go in several rounds.
PHRASE_WORDS = 2_000_000
SEPARATORS = {b for b in range(128) if not chr(b).isalnum()}


def suffix_array(seq: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sorted suffixes.  ``first`` ranks single symbols; separators must all differ."""
    n = len(seq)
    rank = np.append(first, 0).astype(np.int64)  # the end sorts first
    base = int(rank.max()) + 2
    key = rank[:n].copy()
    for t in (1, 2):
        key = key * base + np.append(rank[t:n] + 1, np.zeros(t, dtype=np.int64))
    sa = np.argsort(key, kind="stable")
    width = 3

    def ranks(order: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group starts as ranks, and whether a group has more than one."""
        new = np.append(True, keys[1:] != keys[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        many = ~(new & np.append(new[1:], True))
        rank[order] = at[start]
        return start, many

    places = np.arange(n)
    _, many = ranks(sa, key[sa], places)
    places = places[many]
    while len(places):
        todo = sa[places]
        nxt = np.where(todo + width < n, rank[np.minimum(todo + width, n)] + 1, 0)
        key = rank[todo] * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        sa[places] = todo[order]
        _, many = ranks(sa[places], key[order], places)
        places = places[many]
        width *= 2
    return sa


class FmIndex:
    """Counts and locates phrases in a sequence of numbers; 0 separates."""

    def __init__(self, seq: np.ndarray, sigma: int):
        n = len(seq)
        zero = seq == 0
        self.n, seps = n, int(zero.sum())
        first = np.where(zero, np.cumsum(zero) - 1, seq + seps)
        sa = suffix_array(seq, first)
        self.start = np.zeros(sigma + 2, dtype=np.int64)
        self.start[1:] = np.cumsum(np.bincount(seq, minlength=sigma + 1))
        bwt = np.where(sa > 0, seq[sa - 1], 0)
        taken = (sa % SAMPLE == 0) | (bwt == 0)
        self.sampled, self.positions = np.append(0, np.cumsum(taken)), sa[taken]
        self.taken = taken
        # wavelet matrix: from the highest bit down, zeros before ones at each level
        self.levels: list[tuple[np.ndarray, int, int]] = []
        level = bwt
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            ones = (level >> bit & 1).astype(bool)
            before = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = n - int(before[-1])
            self.levels.append((before, zeros, bit))
            level = np.concatenate([level[~ones], level[ones]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before place i of the transform."""
        lo = np.zeros_like(i)
        for before, zeros, bit in self.levels:
            one = (c >> bit & 1).astype(bool)
            a, b = before[lo], before[i]
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
        return i - lo

    def symbol(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for before, zeros, _ in self.levels:
            a = before[i]
            one = before[i + 1] > a
            c = c * 2 + one
            i = np.where(one, zeros + a, i - a)
        return c

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase; phrases are padded on the left with 0."""
        c = phrases[:, -1]
        lo, hi = self.start[c], self.start[c + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            c = phrases[:, k]
            go = np.flatnonzero((lo < hi) & (c > 0))
            if not len(go):
                continue
            c = c[go]
            lo[go], hi[go] = self.start[c] + self.rank(c, lo[go]), self.start[c] + self.rank(c, hi[go])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by steps back to a sampled one."""
        out, steps = np.zeros(len(rows), dtype=np.int64), 0
        todo, at = np.arange(len(rows)), rows
        while len(todo):
            here = self.taken[at]
            out[todo[here]] = self.positions[self.sampled[at[here]]] + steps
            todo, at = todo[~here], at[~here]
            c = self.symbol(at)
            at = self.start[c] + self.rank(c, at)
            steps += 1
        return out


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(int(counts.sum()))


class Phrases:
    """The distinct word windows of some items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.words = Words(SEPARATORS)
        found: dict[tuple, list[int]] = {}
        self.names = [i for i, _ in items]
        vocabulary: set[int] = set()
        for k, (_, text) in enumerate(items):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            h = self.words.of(data)[2].tolist()
            vocabulary.update(h)
            for i in range(max(1, len(h) - window + 1)) if h else ():
                found.setdefault(tuple(h[i : i + window]), []).append(k)
        self.vocabulary = np.array(sorted(vocabulary), dtype=np.uint64)
        self.length = np.array([len(w) for w in found], dtype=np.int64)
        width = max([window, *self.length.tolist()])
        self.matrix = np.zeros((len(found), width), dtype=np.int64)
        for row, w in enumerate(found):
            self.matrix[row, width - len(w) :] = np.searchsorted(self.vocabulary, np.array(w, dtype=np.uint64)) + 1
        owners = list(found.values())
        self.owner_count = np.array([len(set(x)) for x in owners], dtype=np.int64)
        self.owner = np.array([k for x in owners for k in sorted(set(x))], dtype=np.int64)
        self.owner_start = np.append(0, np.cumsum(self.owner_count))[:-1] if len(found) else np.zeros(0, np.int64)
        self.shortest = int(self.length.min()) if len(found) else 0
        self.quick = np.zeros(1 << 16, dtype=bool)
        self.quick[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 1, or 0."""
        out = np.zeros(len(hashes), dtype=np.int64)
        if not len(self.vocabulary):
            return out
        some = np.flatnonzero(self.quick[(hashes >> np.uint64(48)).astype(np.int64)])
        h = hashes[some]
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == h
        out[some[same]] = at[same] + 1
        return out


def _hits(phrases: Phrases, number: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word is inside an occurrence, and (document, item) pairs, of one shard."""
    hit = np.zeros(len(number), dtype=bool)
    none = hit, np.empty((2, 0), dtype=np.int64)
    if not len(number) or not len(phrases.length):
        return none
    known = number > 0
    cut = np.append(True, (doc[1:] != doc[:-1]) | ~known[1:] | ~known[:-1])
    start = np.flatnonzero(cut & known)
    if not len(start):
        return none
    begins = np.flatnonzero(cut)
    length = np.append(begins[1:], len(number))[np.searchsorted(begins, start)] - start
    keep = length >= phrases.shortest
    start, length = start[keep], length[keep]
    if not len(start):
        return none
    place = _ragged(start, length)
    ends = np.cumsum(length)
    seq = np.insert(number[place], ends, 0)
    where = np.insert(place, ends, -1)
    index = FmIndex(seq, len(phrases.vocabulary))
    lo, hi = index.search(phrases.matrix)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return none
    times = hi[found] - lo[found]
    at = index.locate(_ragged(lo[found], times))
    phrase = np.repeat(found, times)
    word = where[at]
    edge = np.zeros(len(number) + 1, dtype=np.int64)
    np.add.at(edge, word, 1)
    np.add.at(edge, word + phrases.length[phrase], -1)
    hit = np.cumsum(edge[:-1]) > 0
    owners = phrases.owner_count[phrase]
    pairs = np.stack([np.repeat(doc[word], owners), phrases.owner[_ragged(phrases.owner_start[phrase], owners)]])
    return hit, np.unique(pairs, axis=1)


class Shard:
    """What one run over a list of texts finds."""

    def __init__(self, phrases: Phrases, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        if n > 1:  # a separator after each text
            data = np.insert(data, offsets[1:-1], np.uint8(32))
            offsets = offsets + np.arange(n + 1)
            offsets[-1] -= 1
        self.starts, self.ends, h = phrases.words.of(data)
        self.offsets = offsets
        first = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(first)
        doc = np.repeat(np.arange(n), self.n_words)
        self.hit, pairs = _hits(phrases, phrases.numbers(h), doc)
        self.n_hit = np.bincount(doc[self.hit], minlength=n)
        cut = np.searchsorted(pairs[0], np.arange(n + 1))
        self.items = [pairs[1][cut[i] : cut[i + 1]] for i in range(n)]
        self.first = first

    def join(self, hits: list[list[int]]) -> None:
        """Adds words (their places in each text) that earlier rounds hit."""
        for row, places in enumerate(hits):
            self.hit[self.first[row] + np.array(places, dtype=np.int64)] = True
            self.n_hit[row] = self.hit[self.first[row] : self.first[row + 1]].sum()

    def words_hit(self, row: int) -> list[int]:
        return np.flatnonzero(self.hit[self.first[row] : self.first[row + 1]]).tolist()

    def spans(self, row: int) -> list[tuple[int, int]]:
        """Byte spans of the merged runs of hit words of a text."""
        a, b = self.first[row], self.first[row + 1]
        hit = self.hit[a:b].astype(np.int8)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
        base = self.offsets[row]
        return [(int(self.starts[a + x] - base), int(self.ends[a + y - 1] - base)) for x, y in zip(edge[::2], edge[1::2], strict=True)]


def _without(phrases: Phrases, text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans; where what is left meets as a phrase anew, that goes too."""
    while spans:
        out, at = [], 0
        for a, b in spans:
            out.append(text[at:a])
            at = b
        out.append(text[at:])
        text = b"".join(out)
        spans = Shard(phrases, np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])).spans(0)
    return text


def _search(phrases: Phrases, extra: bool, schema: pa.Schema, last: bool = True):
    """One round over rows (key, text[, words hit, items] of earlier rounds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + SHARD, side="right")) - 1)
                j = min(j, batch.num_rows)
                data = raw[off[i] : off[j]]
                shard = Shard(phrases, data, off[i : j + 1] - off[i])
                names = [[phrases.names[k] for k in x] for x in shard.items]
                if batch.num_columns > 2:
                    names = [x + y for x, y in zip(batch.column(3).slice(i, j - i).to_pylist(), names, strict=True)]
                    shard.join(batch.column(2).slice(i, j - i).to_pylist())
                listed = pa.array(names, pa.list_(pa.string()))
                if not last:
                    columns = [*(batch.column(k).slice(i, j - i) for k in (0, 1)), pa.array([shard.words_hit(r) for r in range(j - i)], pa.list_(pa.int64())), listed]
                else:
                    columns = [batch.column(0).slice(i, j - i), pa.array(shard.n_words, pa.int64()), pa.array(shard.n_hit, pa.int64()), listed]
                if last and extra:
                    spans, left = [], []
                    for row in range(j - i):
                        s = shard.spans(row) if shard.n_hit[row] else []
                        spans.append([x for p in s for x in p])
                        left.append(_without(phrases, data[off[i + row] - off[i] : off[i + row + 1] - off[i]].tobytes(), s).decode("utf-8", "replace") if s else None)
                    columns += [pa.array(spans, pa.list_(pa.int64())), pa.array(left, pa.string())]
                yield pa.record_batch(columns, schema=schema)
                i = j

    return run


def _rounds(items: DataFrame, item_id: str, item_text: str, window: int) -> list[Callable[[], Phrases]]:
    """The phrases of the items in rounds of about PHRASE_WORDS words, each made when it is called."""
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = named.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-size // (6 * PHRASE_WORDS)))
    part = lambda r: named if n == 1 else named.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == r)
    return [lambda r=r: Phrases(sorted(map(tuple, part(r).collect())), window) for r in range(n)]


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, spans: bool = False) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_hit, items, and with ``spans`` the byte spans to
    remove (start, end, start, end, ...) and ``cleaned``, the text without them (null: unchanged).

    Words are runs of 0-9, a-z and characters from 128 on, A-Z lower-cased.  An item's
    phrases are its windows of ``window`` words; a shorter item is one phrase, an item
    without words none.  A null or empty text has no words.  Rows are never merged, so
    repeated or null keys keep their rows.  Items with a null id are known by the name
    "null".  Without items nothing is hit; an empty table gives no rows.
    """
    fields = [("key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))] + [("spans", pa.list_(pa.int64())), ("cleaned", pa.string())] * spans
    kind = "key long, n_words long, n_hit long, items array<string>" + ", spans array<long>, cleaned string" * spans
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text_col).alias("text"))
    rounds = _rounds(items, item_id, item_text, window)
    for r, phrases in enumerate(rounds):  # more than one only for benchmarks of more than PHRASE_WORDS words or so
        if r == len(rounds) - 1:
            texts = texts.mapInArrow(lean(_search(phrases(), spans, pa.schema(fields))), kind)
        else:
            carried = pa.schema([("key", pa.int64()), ("text", pa.string()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
            texts = texts.mapInArrow(lean(_search(phrases(), False, carried, False)), "key long, text string, hits array<long>, items array<string>")
    return texts.withColumnRenamed("key", key)


def _cleaner(phrases: Phrases, at: int, counted: int | None, hits: int | None, last: bool):
    """One round over whole rows, the text in column ``at``: adds the words hit to the list in the last
    column (``hits``), or cuts what all rounds hit."""
    found = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64())), ("cleaned", pa.string())])
    carried = pa.schema([("row", pa.int64()), ("text", pa.string()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, names = [pa.array(np.arange(batch.num_rows)), batch.column(at)], ["row", "text"]
            if hits is not None:
                none = pa.array([[]] * batch.num_rows, pa.list_(pa.string()))
                columns, names = [*columns, batch.column(hits), none], [*names, "hits", "items"]
            numbered = pa.record_batch(columns, names=names)
            if not last:
                listed = [x for part in _search(phrases, False, carried, False)([numbered]) for x in part.column(2).to_pylist()]
                columns = list(batch.columns)
                columns[hits] = pa.array(listed, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                continue
            cleaned = [x for part in _search(phrases, True, found)([numbered]) for x in part.column(5).to_pylist()]
            if any(x is not None for x in cleaned):
                texts = [t if c is None else c for t, c in zip(batch.column(at).to_pylist(), cleaned, strict=True)]
                columns = list(batch.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if counted is not None:
                    sizes = [n if c is None else len(c) for n, c in zip(columns[counted].to_pylist(), cleaned, strict=True)]
                    columns[counted] = pa.array(sizes, columns[counted].type)
                empty = [c is not None and not any(x.isalnum() or x > "\x7f" for x in c) for c in cleaned]
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([not e for e in empty]))
            yield batch if hits is None else batch.select(range(batch.num_columns - 1))

    return run


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", size_col: str = "n_chars", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with the benchmark's passages cut out of the texts and ``size_col``, where there is
    one, of changed texts counted anew.  A text of which no word is left goes; untouched rows
    (null and empty texts too), repeated rows and other columns stay as they are; an empty
    table or benchmark changes nothing.

    A benchmark of more than PHRASE_WORDS words or so is searched for in rounds, of which the
    last cuts what all have hit; that is done again while it changes a text, since what is left
    may meet as a phrase.
    """
    at, schema = docs.columns.index(text_col), docs.schema
    counted = docs.columns.index(size_col) if size_col in docs.columns else None
    rounds = _rounds(items, item_id, item_text, window)
    if len(rounds) == 1:
        return docs.mapInArrow(lean(_cleaner(rounds[0](), at, counted, None, True)), schema)
    hits = "_hits"
    while hits in docs.columns:
        hits = "_" + hits
    while True:
        marked = docs.withColumn(hits, F.array().cast("array<long>"))
        kind, place = marked.schema, len(docs.columns)
        for phrases in rounds[:-1]:
            marked = marked.mapInArrow(lean(_cleaner(phrases(), at, counted, place, False)), kind)
        marked = materialize(marked, "marked")
        done = materialize(marked.mapInArrow(lean(_cleaner(rounds[-1](), at, counted, place, True)), schema), "cleaned")
        size = lambda t: t.agg(F.count("*"), F.sum(F.length(F.col(text_col)))).first()
        if size(done) == size(docs):
            return done
        docs = done


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size(named).cast("long").alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Window positions over all words are too slow in SQL on whole tables; tested against brute force.
QUERIES, ORACLES = {"op2_decontaminate": op2_decontaminate}, {}
