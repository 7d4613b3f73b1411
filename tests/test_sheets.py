"""The engine's operators on tables made for them."""

from folioscope.operators import sheets


def save(spark, path, **tables):
    for name, (kind, rows) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_known_edges(spark, tmp_path):
    """Keys of any size count, and ends without a row are dropped."""
    lines = [(100, 7), (7, 100), (100, 7), (5000, 7), (5000, 100), (9, 9), (6000, 7), (100, 8), (None, 7), (100, None)]
    at = save(spark, tmp_path, lineitem=("l_partkey long, l_suppkey long", lines), part=("p_partkey long", [(7,), (9,), (100,), (5000,)]), supplier=("s_suppkey long", [(7,), (9,), (100,)]))
    assert sorted(map(tuple, sheets.known_edges(spark, at).collect())) == [(100, 1, 7), (5000, 2, 7)]


def test_reference_resolution(spark, tmp_path):
    nations = [(1, "N1", 4), (2, "N2", 9)]
    at = save(spark, tmp_path, supplier=("s_suppkey long, s_nationkey long", [(1, 1), (2, 2), (3, 3)]), nation=("n_nationkey long, n_name string, n_regionkey long", nations), region=("r_regionkey long, r_name string", [(0, "R0"), (4, "R4")]))
    assert sorted(map(tuple, sheets.reference_resolution(spark, at).collect())) == [(1, "N1", "R4"), (2, "N2", "[unit omitted]"), (3, "[context omitted]", "[unit omitted]")]
