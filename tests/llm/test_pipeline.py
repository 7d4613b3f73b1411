"""The whole pipeline on small tables: odd rows, copies, no rows, no labels."""

import random
import re

import pytest

import corpus_pipeline
from folioscope.llm import stages

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the river ran past old mill and through quiet town where nobody knew why lights had gone out so early in that cold winter when she opened her window because room was too warm for them".split()


def run(spark, path, docs, items, labels):
    spark.createDataFrame(docs, KIND).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return corpus_pipeline.run(spark, str(path))


def test_odd_rows(spark, tmp_path):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n)) + "."
    docs = [(i, text(60), "en", "s", 1) for i in range(40)]
    mean = "you are a stupid worthless idiot and a pathetic loser, you moron."
    docs += [(100 + i, f"{mean} {text(20)}", "en", "s", 1) for i in range(40)]
    item = text(30)
    copy = text(80)
    docs += [(200, f"{text(40)} {item} {text(40)}", "en", "s", 1), (201, copy, "en", "t", 1), (202, copy, "en", "t", 1), (202, copy, "en", "t", 1), (203, copy + " More.", "en", None, 1)]
    docs += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, "%%% 12", "en", "s", 6), (None, text(50), "en", "s", 1)]
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 1) for i in range(40)]
    got = {x.doc_id: x for x in run(spark, tmp_path, docs, [(1, item), (2, None)], labels).collect()}
    assert {k for k in got if k is not None and k < 40} == set(range(40)) and None in got
    assert not any(k is not None and 100 <= k < 140 or k in (300, 301, 302) for k in got)
    assert [k for k in got if k in (201, 202, 203)] == [201]
    assert got[200].n_tokens < 130 and all(re.fullmatch("[0-9a-f]{64}", x.ids_sha256) for x in got.values())


@pytest.mark.parametrize("docs", [[], [(1, None, None, None, None)], [(1, "a b c", "en", "s", 5)] * 3])
def test_few_rows(spark, tmp_path, docs):
    got = run(spark, tmp_path, docs, [], []).collect()
    assert len(got) <= 1 and all(r.n_tokens >= 0 for r in got)


def test_intermediate_tables_go(spark, tmp_path):
    import os

    mark = stages.written()
    stages.materialize(spark.range(3))
    path = stages._written[-1].removeprefix("file:")
    assert os.path.isdir(path)
    stages.discard(spark, mark)
    assert not os.path.exists(path) and stages.written() == mark
