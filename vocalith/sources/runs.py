"""Runs that are made in several goes: what is left to do, and a merge of new rows that a crash at any point leaves whole.

A run is a folder with ``run.json`` and ``results.parquet``, whose rows are dealt to buckets by utterance. A merge first stages the buckets that it
changes, whole, and then overwrites just these. Staged buckets that were finished but not put in place are put there by whoever comes
next, so a merge that is killed and run again ends in the same folder, and one that is run twice changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.sources import schemas as S

#: Fields of ``run.json`` in which a run's goes must agree.
FIXED = ("config_id", "provider", "model_id", "mode", "settings", "keyterms", "sample")
BUCKETS = 16
_FIELDS = [f.split()[0] for f in S.RUN.split(", ")]


class RunConflict(ValueError):
    """A run was made with other settings than it is to go on with."""


class _Store:
    """The few file operations that a run needs, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.path().getFileSystem(conf)

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def has(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def read(self, name: str) -> str:
        with_bytes = self.fs.open(self.path(name))
        try:
            return bytes(with_bytes.readAllBytes()).decode()
        finally:
            with_bytes.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside its place and moved there."""
        out = self.fs.create(self.path(f".{name}.new"), True)
        try:
            out.write(text.encode())
        finally:
            out.close()
        self.fs.delete(self.path(name), False)
        if not self.fs.rename(self.path(f".{name}.new"), self.path(name)):
            raise OSError(f"cannot write {self.folder}/{name}")


def _value(x):
    """A field of ``run.json`` as it compares: settings and samples are JSON, whatever the order of their keys."""
    return json.loads(x) if isinstance(x, str) and x[:1] in "{[" else x


def mismatches(old: Mapping, new: Mapping) -> list[str]:
    return [f for f in FIXED if _value(old.get(f)) != _value(new.get(f))]


def begin(spark: SparkSession, root: str, meta: Mapping) -> dict:
    """The run's ``run.json``, written if there is none; one that differs where goes must agree is refused by the fields' names."""
    if odd := sorted(set(meta) - set(_FIELDS)):
        raise ValueError(f"unknown fields: {odd}")
    store = _Store(spark, f"{root}/{meta['run_id']}")
    if store.has("run.json"):
        old = json.loads(store.read("run.json"))
        if differ := mismatches(old, meta):
            raise RunConflict(f"run {meta['run_id']} was made with other {', '.join(differ)}; take another run_id")
        _put_in_place(spark, store)
        return old
    store.write("run.json", json.dumps({f: meta.get(f) for f in _FIELDS}, sort_keys=True))
    return dict(meta)


def rows_of(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """A run's rows, with their ``bucket``; none before the first merge."""
    store = _Store(spark, f"{root}/{run_id}")
    if not store.has("results.parquet"):
        return spark.createDataFrame([], f"{S.RESULT}, bucket INT")
    return spark.read.schema(f"{S.RESULT}, bucket INT").parquet(f"{root}/{run_id}/results.parquet")


def _bucket(utt_id: Column) -> Column:
    return F.pmod(F.xxhash64(utt_id), F.lit(BUCKETS)).cast("int")


def _settled(rows: DataFrame, retry_failed: bool) -> DataFrame:
    return rows.where(F.col("error").isNull()) if retry_failed else rows


def todo(spark: SparkSession, root: str, run_id: str, manifest: DataFrame, retry_failed: bool = False, include_excluded: bool = False, limit: int | None = None) -> DataFrame:
    """Utterances of ``manifest`` that the run still lacks. A limit counts those that would be sent, of the first ones by id, before what is done goes."""
    wanted = manifest if include_excluded else manifest.where(F.col("exclude_reason").isNull())
    if limit is not None:
        if limit < 1:
            raise ValueError("a limit is at least 1")
        wanted = wanted.orderBy("utt_id").limit(limit)
    return wanted.join(_settled(rows_of(spark, root, run_id), retry_failed).select("utt_id"), "utt_id", "left_anti")


def _checked(rows: DataFrame, meta: Mapping) -> DataFrame:
    """``rows``, failing where a row is another run's or an utterance comes twice."""
    told = lambda text, *cols: F.raise_error(F.concat(F.lit(text), *cols))
    own = F.when((F.col("run_id") != meta["run_id"]) | (F.col("config_id") != meta["config_id"]), told("row of another run: ", F.col("run_id"), F.lit(" "), F.col("config_id"))).otherwise(F.col("utt_id"))
    names = [f.split()[0] for f in S.RESULT.split(", ")]
    one = rows.select(*[(own if c == "utt_id" else F.col(c)).alias(c) for c in names]).groupBy("utt_id").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*[c for c in names if c != "utt_id"])).alias("r"))
    return one.select(F.when(F.col("n") > 1, told("utterance comes twice: ", F.col("utt_id"))).otherwise(F.col("utt_id")).alias("utt_id"), "r.*").select(*names)


def merge(spark: SparkSession, root: str, meta: Mapping, rows: DataFrame, retry_failed: bool = False) -> None:
    """Put ``rows`` into their run: what is done stays, failed rows are replaced if ``retry_failed``, the rest is added.

    Only buckets with new rows are written. Rows of an empty table change nothing but make the run visible.
    """
    begin(spark, root, meta)
    store = _Store(spark, f"{root}/{meta['run_id']}")
    store.delete("staged.parquet")
    old = rows_of(spark, root, meta["run_id"])
    new = _checked(rows, meta).join(_settled(old, retry_failed).select("utt_id"), "utt_id", "left_anti").withColumn("bucket", _bucket(F.col("utt_id")))
    touched = new.select("bucket").distinct()
    kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(new.select("utt_id"), "utt_id", "left_anti")  # as many rows as buckets at most
    both = kept.unionByName(new.select(*old.columns))
    both.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "utt_id").write.partitionBy("bucket").parquet(f"{store.folder}/staged.parquet")
    _put_in_place(spark, store)


def _put_in_place(spark: SparkSession, store: _Store) -> None:
    """Overwrite the buckets that are staged, if staging was finished."""
    if not store.has("staged.parquet/_SUCCESS"):
        return
    staged = spark.read.schema(f"{S.RESULT}, bucket INT").parquet(f"{store.folder}/staged.parquet")
    _overwrite(staged, f"{store.folder}/results.parquet")
    store.delete("staged.parquet")


def _overwrite(staged: DataFrame, path: str) -> None:
    staged.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "utt_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
