"""Which reference suite fits a profile best, as one ranking over small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUITE = "suite_id STRING, channels ARRAY<STRING>, languages ARRAY<STRING>, entities ARRAY<STRING>"
PROFILE = "profile_id STRING, channel STRING, languages ARRAY<STRING>, entities ARRAY<STRING>, reference_suite STRING"


def match(profiles: DataFrame, suites: DataFrame) -> DataFrame:
    """(profile_id, suite_id, proxy, channel_ok, shared, missing, covered, uncovered) of each profile's best suite.

    Channel first, then shared primary languages, then covered entities, then the first name; a profile that names a suite
    gets that one, and none if it doesn't exist. Suites are a configuration of a few rows, so they join by broadcast.
    """
    primary = F.transform("languages", lambda x: F.lower(F.split_part(x, F.lit("-"), F.lit(1))))
    p = profiles.withColumn("want", F.array_distinct(primary)).withColumnRenamed("entities", "wanted").drop("languages")
    s = suites.select("suite_id", "channels", F.transform("languages", F.lower).alias("has"), F.col("entities").alias("offers"))
    j = p.join(F.broadcast(s), F.col("reference_suite").isNull() | (F.col("reference_suite") == F.col("suite_id")))
    j = j.withColumns({
        "channel_ok": F.array_contains("channels", F.col("channel")), "shared": F.array_sort(F.array_intersect("want", "has")), "missing": F.array_sort(F.array_except("want", "has")),
        "covered": F.array_sort(F.array_intersect("wanted", "offers")), "uncovered": F.array_sort(F.array_except("wanted", "offers")),
    })
    order = Window.partitionBy("profile_id").orderBy(F.desc("channel_ok"), F.desc(F.size("shared")), F.desc(F.size("covered")), "suite_id")
    proxy = ~F.col("channel_ok") | (F.size("missing") > 0) | (F.size("uncovered") > 0)
    return j.withColumn("rk", F.row_number().over(order)).filter("rk = 1").select("profile_id", "suite_id", proxy.alias("proxy"), "channel_ok", "shared", "missing", "covered", "uncovered")
