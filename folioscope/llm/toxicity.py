"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

Features: densities of a fixed lexicon, of one learned from the training rows and of
obfuscated hits, second person near them, capitals, punctuation and symbols.  All are
computed from hashed words of whole buffers.  Trees are grown on binned features of a
bounded sample of labelled rows; a held-back part of it fits the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import lean, table
from .wordhash import Words, slices

#: Labelled rows to train on at most: those with the smallest hashed ids.
SAMPLE = 20_000
LEARNED = 128
LEXICON = ("asshole", "bastard", "bitch", "clown", "crap", "damn", "dirtbag", "disgusting", "dumb", "filthy", "freak", "fool", "garbage", "hate", "idiot", "imbecile", "jerk", "kill", "loser", "moron", "pathetic", "pig", "retard", "rubbish", "scum", "shit", "stupid", "trash", "ugly", "useless", "vermin", "worthless")
SECOND = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "tu", "te", "toi", "ton", "ta", "vous", "votre", "usted", "ustedes", "tus")
NEAR = 4
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = ("fixed", "fixed_log", "learned", "learned_log", "near_second", "second", "obfuscated", "capitals", "shouted", "exclaimed", "punctuation", "symbols", "digits", "word_length", "log_words")

_LETTERS = {b for b in range(128) if not (chr(b).isalpha())}
_LEET = {b for b in range(128) if not (chr(b).isalpha() or chr(b) in LEET)}


class Features:
    def __init__(self, learned: list[str]):
        self.words, self.leet = Words(_LETTERS), Words(_LEET)
        for a, b in LEET.items():
            self.leet.value[ord(a)] = self.words.value[ord(b)]
        self.fixed, self.learned, self.second = map(self._hashes, (LEXICON, learned, SECOND))

    def _hashes(self, words) -> np.ndarray:
        data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
        return np.unique(self.words.of(data)[2])

    def of(self, column: pa.Array) -> np.ndarray:
        out = [self._some(data, off) for _, _, data, off in slices(column)]
        return np.concatenate(out) if out else np.empty((0, len(FEATURES)))

    def _some(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if n > 1:
            data = np.insert(data, off[1:-1], np.uint8(10))
            off = off + np.arange(n + 1)
            off[-1] -= 1
        total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[off]).astype(np.float64)
        chars = np.maximum(np.diff(off), 1)
        starts, ends, h = self.words.of(data)
        first = np.searchsorted(starts, off)
        per = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[first]).astype(np.float64)
        words = np.diff(first).astype(np.float64)
        base = np.maximum(words, 1)
        fixed, learned, second = (np.isin(h, x) for x in (self.fixed, self.learned, self.second))
        hit = np.concatenate(([0], np.cumsum(fixed | learned)))
        at = np.arange(len(h))
        doc = np.repeat(np.arange(n), np.diff(first))
        lo, hi = np.maximum(at - NEAR, first[doc]), np.minimum(at + NEAR + 1, first[doc + 1])
        near = second & (hit[hi] > hit[lo]) if len(h) else second
        s2, e2, h2 = self.leet.of(data)
        found = np.isin(h2, np.union1d(self.fixed, self.learned))
        kind = np.zeros(256, dtype=bool)
        kind[[b for b in range(128) if chr(b).isalpha()]] = True
        kind[128:] = True
        letters = np.concatenate(([0], np.cumsum(kind[data])))
        found &= letters[e2] - letters[s2] < e2 - s2  # with a digit or sign among the letters
        odd = np.diff(np.concatenate(([0], np.cumsum(found)))[np.searchsorted(s2, off)]).astype(np.float64)
        upper = (data >= 65) & (data <= 90)
        ups = np.concatenate(([0], np.cumsum(upper)))
        shout = (ups[ends] - ups[starts] == ends - starts) & (ends - starts > 2)
        punct = np.isin(data, np.frombuffer(b".,;:!?'\"()-", dtype=np.uint8))
        symbol = (data > 32) & (data < 127) & ~kind[data] & ~punct & ~((data >= 48) & (data <= 57))
        f, g = per(fixed), per(learned)
        return np.stack([f / base, np.log1p(f), g / base, np.log1p(g), per(near) / base, per(second) / base, odd / base, total(upper) / chars, per(shout) / base, total(data == 33) / base, total(punct) / chars, total(symbol) / chars, total((data >= 48) & (data <= 57)) / chars, per(ends - starts) / base, np.log1p(words)], axis=1)


class Trees:
    """Boosted trees for 0/1 labels, by histograms of binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        if not len(y):  # nothing is known: no trees, and even odds
            self.base, self.trees, self.edges = 0.0, [], [np.empty(0)] * x.shape[1]
            return self
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.concatenate([np.quantile(c, q), np.quantile(c[c > 0], q[::4]) if (c > 0).any() else []])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        width = int(b.max()) + 1 if b.size else 1
        p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            s = 1 / (1 + np.exp(-f))
            g, h = s - y, s * (1 - s)
            node = np.zeros(len(y), dtype=np.int64)
            split = np.full((2**self.depth, 2), -1, dtype=np.int64)  # of inner nodes, from 1
            for level in range(self.depth):
                nodes = 2**level
                best = np.full(nodes, 1e-6)
                choice = np.full((nodes, 2), -1, dtype=np.int64)
                for k in range(x.shape[1]):
                    at = node * width + b[:, k]
                    gs = np.bincount(at, g, nodes * width).reshape(nodes, width).cumsum(1)
                    hs = np.bincount(at, h, nodes * width).reshape(nodes, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(nodes), top] > best
                    best = np.where(better, gain[np.arange(nodes), top], best)
                    choice[better] = np.stack([np.full(nodes, k), top], axis=1)[better]
                split[nodes : 2 * nodes] = choice
                k, t = choice[node, 0], choice[node, 1]
                node = node * 2 + ((k >= 0) & (b[np.arange(len(y)), np.maximum(k, 0)] > t))
            leaves = 2**self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            self.trees.append((split, value))
            f += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for split, value in self.trees:
            node = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                k, t = split[node, 0], split[node, 1]
                node = node * 2 + ((k >= 0) & (b[rows, np.maximum(k, 0)] > t))
            f += value[node - 2**self.depth]
        return f


class Isotonic:
    """Non-decreasing steps by pooling adjacent violators."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        blocks: list[list[float]] = [[-np.inf, 0.5, 1.0]]  # beginning, sum, weight: a little prior at the ends
        for s in np.unique(score):
            some = y[score == s]
            blocks.append([s, float(some.sum()), float(len(some))])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                _, a, w = blocks.pop()
                blocks[-1][1] += a
                blocks[-1][2] += w
        self.at = np.array([b[0] for b in blocks])
        self.value = np.array([b[1] / b[2] for b in blocks])
        return self

    def of(self, score: np.ndarray) -> np.ndarray:
        return self.value[np.maximum(np.searchsorted(self.at, score, side="right") - 1, 0)]


class ToxicityModel:
    """Fitted on feature rows; every fifth is held back for the calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray, learned: list[str]):
        self.features, self.known = Features(learned), len(y) > 0
        held = np.arange(len(y)) % 5 == 4
        if held.sum() < 2 or not 0 < y[~held].sum() < (~held).sum():
            held[:] = False
        self.trees = Trees().fit(x[~held], y[~held])
        self.scale = Isotonic().fit(self.trees.raw(x[held]), y[held]) if held.any() else None

    def score(self, column: pa.Array) -> np.ndarray:
        f = self.trees.raw(self.features.of(column))
        if not self.known:  # without a labelled row nothing is called toxic
            return np.full(len(f), 0.499)
        plain = 1 / (1 + np.exp(-f))
        # the steps give the level; within a step the trees' own order remains
        return plain if self.scale is None else np.clip(0.98 * self.scale.of(f) + 0.02 * plain, 0, 1)


def in_training(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, y) of at most SAMPLE labelled rows whose id isn't held out."""
    some = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("y")).where("i is not null and y in (0, 1)").where(in_training(F.col("i")))
    some = some.groupBy("i").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("i", F.lit(8))).orderBy("h").limit(SAMPLE)
    # at most SAMPLE rows of two numbers
    return docs.select(F.col("doc_id").cast("long").alias("i"), "text").join(F.broadcast(some), "i").select("h", "text", "y").where("text is not null")


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    rows = _sample(docs, labels)
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))))
    seen = rows.select(word.alias("w"), "y").groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a >= 5")
    sums = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    n1, n0 = (float(v or 0) + 1 for v in sums)
    odds = F.log((F.col("a") + 0.5) / n1) - F.log((F.col("b") + 0.5) / n0)
    top = seen.withColumn("o", odds).where(F.col("o") > 1.5).orderBy(F.desc(F.col("o") * F.sqrt("a")), "w").limit(LEARNED)
    learned = [r["w"] for r in top.collect()]
    # at most SAMPLE rows of numbers come to the driver, no texts
    got = sorted(map(tuple, rows.select("h", "y", "text").mapInArrow(lean(_described(learned)), "h long, y int, x array<double>").collect()))
    x = np.array([r[2] for r in got], dtype=np.float64).reshape(len(got), len(FEATURES))
    return ToxicityModel(x, np.array([r[1] for r in got], dtype=np.float64), learned)


def _described(learned: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(learned)
        for batch in batches:
            if batch.num_rows:
                x = features.of(batch.column(2))
                listed = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.record_batch([batch.column(0), batch.column(1), listed], names=["h", "y", "x"])

    return run


def _scored(model: ToxicityModel):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), pa.array(model.score(batch.column(1)))], schema=schema)

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null text is scored as empty.  Rows with equal or null ids stay separate (a null id is
    not held out).  Without both labels among the training rows every score is the prior,
    the share of toxic ones, or just under a half without any labelled row.
    Other columns are ignored; an empty table gives no rows.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_scored(model)), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, in one pass over whole rows.

    Null and empty texts are scored as empty ones; repeated rows go or stay together; all
    columns are kept as they are; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.score(batch.column(at)) < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


#: A fitted model; tested by held-out accuracy.
QUERIES, ORACLES = {"op8_toxicity": op8_toxicity}, {}
