"""Tables between jobs, kept in the folder that the cluster shares, and set components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Bytes of an Arrow batch, and of one of the whole pipeline, whose executors have had other stages; they hold a few for each task.
BATCH, SMALL = 4 << 20, 1 << 20
ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def limit_batches(spark: SparkSession, most: int) -> None:
    """From now on the session's Arrow batches have so many bytes at most."""
    now = spark.conf.get(ARROW_BATCH, None)
    if now and int(now.removesuffix("b")) > most:
        spark.conf.set(ARROW_BATCH, f"{most}b")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, in batches of bounded bytes; when its task ends, the
    worker, which waits for other work, gives back what its allocators hold."""
    if spark := SparkSession.getActiveSession():
        limit_batches(spark, BATCH)

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)

    return leaner


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster.

    Where none is set, a new folder of this machine serves a session whose driver and
    executor are one process (tests); on a cluster that is an error.
    """
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="folioscope-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: Tables that this process has written and not yet removed, in order.
_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place for an intermediate table, to be removed by ``discard`` or when the driver ends."""
    if not _written:
        atexit.register(_remove_all, spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _remove_all(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        discard(spark)


def written() -> int:
    """How many intermediate tables there are: a mark for ``discard``."""
    return len(_written)


def discard_one(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.remove(path)


def discard(spark: SparkSession, since: int = 0) -> None:
    """Removes the intermediate tables written after the mark; what reads them must be done."""
    for path in _written[since:]:
        discard_one(spark, path)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes a table to the shared folder and reads it again.

    The lineage ends there, and a lost executor takes none of it along.  As Parquet it
    needs a fraction of the room of ``checkpoint()``'s rows.
    """
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: Names a row of a ``numbered`` table, whatever its ids.
ROW = "_row"


def numbered(df: DataFrame) -> DataFrame:
    """``df``, written with a key of its own in each row."""
    return materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The ``numbered`` rows whose keys aren't in ``gone`` (gone), without the key."""
    return rows.join(gone, rows[ROW] == gone["gone"], "left_anti").drop(ROW)


def bucketed(df: DataFrame, key: str, name: str = "t") -> DataFrame:
    """Like ``materialize``, filed by ``key``, so joins on it don't move the table again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    name = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # out of the catalog; its files stay
    return out


def sampled(rows: DataFrame, key: str, value: str, n: int, by: str | None = None, groups: tuple = (None,)) -> DataFrame:
    """(by, h, value) of at most ``n`` distinct keys for each of a few named groups (or of all
    rows): those with the smallest hashes, smallest value first where rows share a key.

    A first pass over ``by`` and ``key`` alone estimates how many keys a group has; only rows
    whose hash is below a bound that leaves about ``3 * n`` of them are moved and sorted, so
    what is moved follows ``n``, neither the rows nor their partitions.
    """
    group, h = F.col(by) if by else F.lit(None).cast("string"), F.xxhash64(key, F.lit(6))
    rows = rows.select(group.alias("g"), h.alias("h"), F.col(value).alias(value))
    if by:
        rows = rows.where(F.col("g").isin(*groups))
    keys = dict(map(tuple, rows.groupBy("g").agg(F.approx_count_distinct("h", 0.02)).collect()))  # one row a group
    bound = F.lit(None).cast("long")
    for g in groups:
        least = int(min(1.0, 3 * n / max(1, keys.get(g, 0))) * (1 << 64)) - (1 << 63)
        bound = F.when(F.col("g").eqNullSafe(F.lit(g)), F.lit(min(least, (1 << 63) - 1))).otherwise(bound)
    some = rows.where(F.col("h") <= bound).groupBy("g", "h").agg(F.min(value).alias(value))
    place = F.row_number().over(Window.partitionBy("g").orderBy("h"))  # about 3 * n rows a group
    return some.withColumn("place", place).where(F.col("place") <= n).select(F.col("g").alias(by or "g"), "h", value)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node reachable.

    Alternates large-star and small-star contraction.  Each step is an aggregate of
    minima and an equi-join with it, so a node of any degree costs one row per task and
    the join's stream side can be split; no neighbour list is ever collected.  Rounds grow
    with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "edges")
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == seen:
            break
        seen = sums
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
