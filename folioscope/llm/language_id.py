"""Language of texts and pages by Bayesian fusion of evidence.

Text: hashed byte trigrams under one model per language and one for text of none, fitted
on a bounded sample of labelled rows.  Declared markup language and the address's
language segment: confusion counts against the text's best language.  Host: a prior
smoothed towards its site, that towards its address suffix, that towards all rows.  All
counts come from grouped aggregation over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import ROW, lean, materialize, numbered, sampled, table, without
from .wordhash import slices

LANGUAGES = ("de", "en", "es", "fr")
CLASSES = (*LANGUAGES, "und")
TABLE = 1 << 16
#: Rows of the training sample for each language, whole texts of any length.
SAMPLE = 200
#: Trigrams count as independent evidence up to this many; more only sharpen the mean.
WEIGHT = 60.0
#: Strength of the smoothing towards the level above.
KAPPA = 8.0
#: Under text of no language a trigram is one of so many: between ordinary sentences of the
#: four languages (at most e**11.74 in a trial of 32) and those of others (e**10.96 to e**13.74).
NOWHERE = 135_000.0
#: A row is rejected if no language reaches this probability.
LEAST = 0.5


def _codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-cased letters, other ASCII bytes as blanks; whether each is centred on a letter."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    letter = (low >= 128) | ((low >= 97) & (low <= 122))
    low = np.where(letter, low, 32).astype(np.int64)
    return ((low[:-2] * 0x9E37 + low[1:-1] * 0x79B9 + low[2:] * 0x7F4B) ^ (low[1:-1] << 7) ^ (low[2:] << 3)) & (TABLE - 1), letter[1:-1]


def _padded(piece: np.ndarray, first: bool, last: bool) -> np.ndarray:
    return np.concatenate(([32] if first else [], piece, [32] if last else [])).astype(np.uint8)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (language, text) to (language, code, n): trigrams centred on a letter, counted over the task's rows."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            data = np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), dtype=np.uint8)
            table = counts.setdefault(lang.as_py(), np.zeros(TABLE, dtype=np.int64))
            for at in range(0, len(data), 1 << 20):  # a long text comes in parts
                code, letter = _codes(_padded(data[max(0, at - 1) : at + (1 << 20) + 1], at == 0, at + (1 << 20) >= len(data)))
                table += np.bincount(code[letter], minlength=TABLE)
    for lang, table in counts.items():
        some = np.flatnonzero(table)
        yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(table[some])], names=["lang", "code", "n"])


class TextModel:
    """Trigram models from counts of (language, code); letters in any number of texts."""

    def __init__(self, found: list[tuple[str, int, int]]):
        counts = np.zeros((len(CLASSES), TABLE))
        for lang, code, n in found:
            counts[LANGUAGES.index(lang), code] += n
        every = counts.sum(axis=0) + 0.5
        every /= every.sum()
        total = counts.sum(axis=1, keepdims=True)
        p = (counts + 200.0 * every) / (total + 200.0)
        p = 0.98 * p + 0.02 / TABLE
        p[-1] = 1.0 / NOWHERE
        self.table = np.log(p).T.astype(np.float32).copy()

    def score(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Mean log-likelihood under each class, and number of letters, of each run of rows."""
        for i, j, data, offsets in slices(column):
            n = j - i
            sums, letters = np.zeros((n, len(CLASSES))), np.zeros(n, dtype=np.int64)
            for at in range(0, max(1, len(data)), 1 << 20):  # a long text comes in parts
                piece = data[max(0, at - 1) : at + (1 << 20) + 1]
                padded = _padded(piece, at == 0, at + (1 << 20) >= len(data))
                if len(padded) < 3:
                    continue
                code, letter = _codes(padded)
                edges = np.clip(offsets - at, 0, len(code))
                some = np.flatnonzero(edges[1:] > edges[:-1])
                if not len(some):
                    continue
                where = np.flatnonzero(letter)
                cut = np.searchsorted(where, edges)
                ll = self.table[code[where]]
                full = np.flatnonzero(cut[1:] > cut[:-1])
                if len(full):
                    sums[full] += np.add.reduceat(ll, cut[full], axis=0)[: len(full)] if cut[full[-1] + 1] == len(where) else np.stack([ll[cut[r] : cut[r + 1]].sum(axis=0) for r in full])
                    letters[full] += (cut[1:] - cut[:-1])[full]
            yield sums / np.maximum(letters, 1)[:, None], letters


def _scored(model: TextModel, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = list(model.score(batch.column(batch.num_columns - 1)))
            mean, letters = np.concatenate([m for m, _ in parts]), np.concatenate([n for _, n in parts])
            ll = mean * np.minimum(letters, WEIGHT)[:, None]
            listed = pa.FixedSizeListArray.from_arrays(pa.array(ll.ravel()), len(CLASSES)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns[:-1], listed, pa.array(letters)], names=[*names, "ll", "letters"])

    return run


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> TextModel:
    """Fits on SAMPLE rows of each language, those with the smallest hashed ids.

    Whole texts are counted where they lie; at most TABLE counts a language come to the driver.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    some = sampled(rows, "id", "text", SAMPLE, "lang", LANGUAGES).select("lang", "text")
    counted = some.mapInArrow(lean(_tables), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n"))
    return TextModel(list(map(tuple, counted.collect())))


def _best(ll: Column) -> Column:
    """Position, from 1, of the most likely class."""
    return F.array_position(ll, F.array_max(ll)).cast("int")


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """(kind, id, lang, p, letters, rejected) for rows (kind, id, host, site, suffix, declared, segment, text).

    Nulls in host, site, suffix, declared or segment mean no such evidence (all such rows
    share one group).  A text without letters has no text evidence and is rejected, as is a
    row for which no language reaches LEAST.  Repeated rows stay; an empty table gives none.
    """
    names = ["kind", "id", "host", "site", "suffix", "declared", "segment"]
    kind = "kind string, id long, host string, site string, suffix string, declared string, segment string, ll array<double>, letters long"
    scored = materialize(rows.select(*names, "text").mapInArrow(lean(_scored(model, names)), kind), "scored")
    known = scored.where("letters > 0").withColumn("best", _best(F.col("ll")))
    hosts = known.groupBy("kind", "suffix", "site", "host", "best").agg(F.count("*").alias("n"))
    hosts = materialize(hosts, "hosts")

    def level(keys: list[str], above: DataFrame | None, to: str) -> DataFrame:
        cells = hosts.groupBy(*keys).agg(*(F.sum(F.when(F.col("best") == k + 1, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(CLASSES))))
        total = sum((F.col(f"n{k}") for k in range(len(CLASSES))), F.lit(0))
        if above is None:
            prior = F.array(*[(F.col(f"n{k}") + 1.0) / (total + float(len(CLASSES))) for k in range(len(CLASSES))])
            return cells.select(*keys, prior.alias(to))
        same = [F.col(f"c.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys[:-1]]
        joined = cells.alias("c").join(above.alias("u"), on=same, how="inner")
        prior = F.array(*[(F.col(f"c.n{k}") + KAPPA * F.col("u.up")[k]) / (total + KAPPA) for k in range(len(CLASSES))])
        return joined.select(*[F.col(f"c.{k}").alias(k) for k in keys], prior.alias(to))

    top = level(["kind"], None, "up")
    by_suffix = level(["kind", "suffix"], top, "up")
    by_site = level(["kind", "suffix", "site"], by_suffix, "up")
    by_host = materialize(level(["kind", "suffix", "site", "host"], by_site, "prior"), "priors")

    def confusion(column: str) -> dict[str, list[float]]:
        """log P(declared | language), for the declared values that are languages."""
        wide = known.where(F.col(column).isin(*LANGUAGES)).groupBy(column, "best").count().collect()  # at most 4 x 5 rows
        n = np.ones((len(LANGUAGES), len(CLASSES)))
        for r in wide:
            n[LANGUAGES.index(r[0]), r[1] - 1] += r[2]
        return {c: np.log(n[k] / n.sum(axis=0)).tolist() for k, c in enumerate(LANGUAGES)}

    def evidence(column: str) -> Column:
        found = confusion(column)
        out = F.array(*[F.lit(0.0)] * len(CLASSES))
        for c, v in found.items():
            out = F.when(F.col(column) == c, F.array(*map(F.lit, v))).otherwise(out)
        return out

    joined = scored.alias("r").join(by_host.alias("h"), on=[F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in ("kind", "suffix", "site", "host")], how="left").select("r.*", "h.prior")
    flat = F.array(*[F.lit(1.0 / len(CLASSES))] * len(CLASSES))
    joined = joined.withColumn("e1", evidence("declared")).withColumn("e2", evidence("segment")).withColumn("prior", F.coalesce("prior", flat))
    total = F.array(*[F.col("ll")[k] + F.log(F.col("prior")[k]) + F.col("e1")[k] + F.col("e2")[k] for k in range(len(CLASSES))])
    joined = joined.withColumn("s", total).withColumn("top", F.array_max("s"))
    p = 1.0 / F.aggregate(F.transform("s", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b)
    lang = F.element_at(F.array(*map(F.lit, CLASSES)), _best(F.col("s")))
    out = joined.select("kind", "id", lang.alias("lang"), p.alias("p"), "letters")
    return out.withColumn("rejected", (F.col("letters") == 0) | (F.col("lang") == "und") | (F.col("p") < LEAST))


def document_rows(docs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return docs.select(F.lit("documents").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("host"), none.alias("site"), none.alias("suffix"), none.alias("declared"), none.alias("segment"), F.col("text").alias("text"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Host parts and language segment of the address, declared language and text of the markup."""
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    html = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    text = F.regexp_replace(html, r"&[#a-zA-Z0-9]{1,8};", " ")
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1))
    segment = F.lower(F.regexp_extract("url", r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return pages.select(F.lit("pages").alias("kind"), F.col("page_id").cast("long").alias("id"), host.alias("host"), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".").alias("site"), F.element_at(labels, -1).alias("suffix"), declared.alias("declared"), segment.alias("segment"), text.alias("text"))


def drop_foreign(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects, whatever their ids.

    What is joined is the list of rejected rows alone, of a size that Spark knows.
    """
    rows = numbered(docs)
    found = identify(document_rows(rows.withColumn("doc_id", F.col(ROW))), fit(docs)).where("rejected")
    return without(rows, materialize(found.select(F.col("id").alias("gone")), "rejected"))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    out = identify(document_rows(docs).unionByName(page_rows(pages)), fit(docs))
    return out.select(F.when(F.col("kind") == "documents", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "pages", F.col("id")).alias("page_id"), "lang", "p", "letters", "rejected")


#: A fitted model; tested by held-out accuracy.
QUERIES, ORACLES = {"op6_language_id": op6_language_id}, {}
