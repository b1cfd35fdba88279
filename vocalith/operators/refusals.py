"""Refusals inside plans: rows that have no honest answer fail the query by name, where a join or a division would drop them silently.

The check is part of the plan, on rows that are computed anyway; no count runs before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _refused(when: Column, value: Column, *said: Column | str) -> Column:
    """``value``, unless ``when``: then the query fails with a text."""
    text = F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("null")) for x in said])
    return F.when(when, F.raise_error(text)).otherwise(value)


def pooled(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, errors, n_ref, pooled_wer, mean_utt_wer) of ``scores`` (n_ref, errors): a group without reference words is refused.

    Empty references count with their insertions in the pooled rate and not at all in the mean.
    """
    g = scores.groupBy(*keys).agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("n_ref"), F.lit(0)).alias("n_ref"), F.avg(F.try_divide("errors", F.nullif("n_ref", F.lit(0)))).alias("mean_utt_wer"))
    n = _refused(F.col("n_ref") == 0, F.col("n_ref"), "no reference words: ", F.concat_ws(", ", *keys) if keys else "all")
    return g.withColumn("n_ref", n).select(*keys, "errors", "n_ref", (F.col("errors") / F.col("n_ref")).alias("pooled_wer"), "mean_utt_wer")


def with_clusters(rows: DataFrame, clusters: DataFrame, key: str = "utt_id") -> DataFrame:
    """``rows`` with the ``cluster`` of their ``key``; a row without one, or with several, is refused."""
    one = clusters.groupBy(key).agg(F.min("cluster").alias("cluster"), F.max("cluster").alias("_other"))
    joined = rows.join(one, key, "left")
    found = _refused(F.col("cluster").isNull(), F.col("cluster"), "no cluster for ", F.col(key))
    found = _refused(F.col("cluster") != F.col("_other"), found, "several clusters for ", F.col(key))
    return joined.withColumn("cluster", found).drop("_other")


def paired_configs(clean: DataFrame, augmented: DataFrame, fields: Sequence[str] = ("model_id", "settings")) -> DataFrame:
    """(config_id) of runs that are in both; a config that differs in one of the fields is refused by its name and theirs."""
    other = augmented.select("config_id", *[F.col(f).alias(f"_{f}") for f in fields])
    both = clean.select("config_id", *fields).join(other, "config_id")
    odd = F.concat_ws(", ", *[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields])
    return both.select(_refused(odd != "", F.col("config_id"), F.col("config_id"), " differs in ", odd).alias("config_id"))
