"""Decontamination of whole rows, also of benchmarks that take several rounds."""

import random

import pytest

from folioscope.llm import decontaminate

KIND = "doc_id long, text string, n_chars long, row long, key long, hits long, spans int, cleaned string"


def tables(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(400)}"
    items = [" ".join(word() for _ in range(r.choice([3, 12, 25]))) for _ in range(40)] + ["", None]
    texts = [None, "", "%%%"]
    for _ in range(60):
        part = [word() for _ in range(r.randrange(30))]
        for _ in range(r.randrange(3)):
            part += r.choice(items[:40]).split()[:14] + [word() for _ in range(r.randrange(8))]
        texts.append(" ".join(part))
    texts += texts[-2:]
    docs = spark.createDataFrame([(i % 40, t, len(t or ""), 1, 2, 3, 4, "x") for i, t in enumerate(texts)], KIND)
    return docs.repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


@pytest.mark.parametrize("words", [2_000_000, 60])
def test_nothing_is_left(spark, monkeypatch, words):
    monkeypatch.setattr(decontaminate, "PHRASE_WORDS", words)
    docs, items = tables(spark)
    found = {r.doc_id: 0 for r in docs.collect()}
    for r in decontaminate.contamination(docs, items, spans=True).collect():
        found[r.doc_id] += r.n_hit
    assert sum(found.values()) > 100
    left = decontaminate.clean_documents(docs, items)
    assert left.columns == docs.columns
    assert decontaminate.contamination(left, items).where("n_hit > 0").isEmpty()
    clean = {k for k, n in found.items() if not n}
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id in clean and r.text) == sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in clean and r.text)
    blank = "text is null or text in ('', '%%%')"
    assert left.where("n_chars <> length(text)").isEmpty() and left.where(blank).count() == docs.where(blank).count()


def test_rounds_agree(spark, monkeypatch):
    docs, items = tables(spark)
    rows = lambda: sorted((r.doc_id, r.n_words, r.n_hit, sorted(set(r["items"]))) for r in decontaminate.contamination(docs, items).collect())
    once = rows()
    monkeypatch.setattr(decontaminate, "PHRASE_WORDS", 50)
    assert rows() == once


def test_tables_without_a_size(spark):
    docs, items = tables(spark)
    left = decontaminate.clean_documents(docs.select("text"), items)
    assert left.columns == ["text"]
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.clean_documents(docs.limit(0), items).isEmpty()
