"""What the operators of this subpackage share: reading, cutting lineage, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session in local mode, where there is one machine, may leave it unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    made = tempfile.mkdtemp(prefix="vocalith-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vocalith/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vocalith_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of ``cut`` after their last reader has written what it made of them."""
    for df in written:
        if path := getattr(df, "_vocalith_path", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


#: Rows of whole texts that go to a Python worker at once.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Send whole texts to Python in small batches: the default of 10,000 rows is for narrow ones. Another setting is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXT_ROWS))


def tidy(batches):
    """The batches; once they end, memory that a Python worker's task no longer needs goes back, as workers outlive tasks."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: freed memory stays with the process
        pass


def unit_interval(*cols: Column) -> Column:
    """A hash of ``cols`` as a double in (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") + 0.5) / float(2**52)


def spare_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores in front until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a written table has at most ``rows`` rows: the check before a broadcast."""
    return df.count() <= rows


#: Parts that a node's neighbours are dealt into, so that a hub's rows meet in as many tasks.
PARTS = 64


def _least_neighbour(rows: DataFrame) -> DataFrame:
    """``rows`` (u, v) with ``m``, the least v of its u: a minimum for each part of u's rows, and then one of these for u."""
    part = F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")
    rows = rows.withColumn("part", part)
    parts = rows.groupBy("u", "part").agg(F.min("v").alias("m"))
    low = parts.select("u", "part").join(parts.groupBy("u").agg(F.min("m").alias("m")), "u")
    return rows.join(low, ["u", "part"]).select("u", "v", "m")


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of the graph with ``edges`` (a, b): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps until the edges are stars. A node's least neighbour comes from minima of parts of its
    rows, and rows are joined by node and part, so a hub with any number of neighbours is dealt over tasks. Each step's
    table goes when the next is written. Nodes without edges are absent.
    """

    def stamp(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        return tuple(r)

    def step(e: DataFrame, made: DataFrame) -> DataFrame:
        out = cut(made, tag)
        discard(e)
        return out

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), tag)
    seen = stamp(e)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = _least_neighbour(both).where("v > u")
        e = step(e, near.select(F.col("v").alias("a"), F.least("u", "m").alias("b")).where("a != b").distinct())
        near = _least_neighbour(e.select(F.col("a").alias("u"), F.col("b").alias("v")))
        e = step(e, near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b")).distinct())
        now = stamp(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
