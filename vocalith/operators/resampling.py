"""Bootstrap intervals of percentiles from histograms: mergeable Poisson resamples, whose cost doesn't follow sessions times draws.

A resample weighs each cluster by a Poisson number of mean 1, drawn by hash. Values are counted in bins of ``DIGITS`` significant digits, a histogram a
cluster; a resample's histogram is the weighted sum of these, which tasks add up before anything moves. Resampling the m values of a bin
one by one is a Poisson number of mean m, so that a bin takes one draw, however many values it has. What is shuffled grows with bins and resamples alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS, RESAMPLES = 3, 200
#: Below this mean a Poisson number is drawn from its distribution; from it on, it is a rounded normal one.
NORMAL = 13
PERCENTILES = (50, 95, 99)


def bin_of(v: Column, digits: int = DIGITS) -> Column:
    """The lower end of a value's bin: its leading digits, of which values below the bin count lose none but the fraction; infinity is its own bin."""
    whole = F.floor(v).cast("bigint")
    unit = F.pow(F.lit(10.0), F.greatest(F.length(F.abs(whole).cast("string")) - digits, F.lit(0)))
    return F.when(v.cast("double") == float("inf"), v.cast("double")).otherwise(F.floor(whole / unit) * unit)


def uniform(*key: Column | str) -> Column:
    """A number in (0, 1) by hash of texts."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def _ladder(mean: int) -> list[float]:
    """The distribution function of the Poisson number of a mean at 0, 1, ..., as far as it differs from 1."""
    terms, k = [math.exp(-mean)], 0
    while k < mean or 1 - math.fsum(terms) > 1e-11:
        k += 1
        terms.append(terms[-1] * mean / k)
    return [math.fsum(terms[: i + 1]) for i in range(len(terms))]


def _steps(ladders: Column, u: Column) -> Column:
    """How many steps of a ladder a number is not below; it is computed once."""
    return F.get(F.transform(F.array(u), lambda x: F.size(F.filter(ladders, lambda step: x >= step))), 0).cast("bigint")


def _literal(means: Sequence[int]) -> Column:
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in _ladder(m)) + ")" for m in means) + ")")


def poisson_one(*key: Column | str) -> Column:
    """A Poisson number of mean 1, by hash."""
    return _steps(F.get(_literal([1]), F.lit(0)), uniform(*key))


def poisson(mean: Column, *key: Column | str) -> Column:
    """A Poisson number of a whole mean from 1 on, by hash."""
    few = _steps(F.get(_literal(range(1, NORMAL)), (mean - 1).cast("int")), uniform(*key))
    normal = F.sqrt(-2 * F.log(uniform(*key, "a"))) * F.cos(2 * math.pi * uniform(*key, "b"))
    return F.when(mean < NORMAL, few).otherwise(F.greatest(F.lit(0), F.floor(mean + F.sqrt(mean.cast("double")) * normal + 0.5)).cast("bigint"))


def _summed(rows: DataFrame, resamples: int, keys: Sequence[str]) -> DataFrame:
    """(keys, b, bin, w) of rows (keys, bin, n, w): sums of ``n * w[b]``, of which each task makes one row a bin first."""
    sums = [F.expr(f"sum(n * w[{b}]) AS s{b}") for b in range(resamples)]
    return rows.groupBy(*keys, "bin").agg(*sums).select(*keys, "bin", F.posexplode(F.expr("array(" + ", ".join(f"s{b}" for b in range(resamples)) + ")")).alias("b", "w"))


def clustered(values: DataFrame, seed: str, resamples: int = RESAMPLES, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, b, bin, w) on resamples of clusters, of ``values`` (keys, cluster, v). All groups share the draws of a cluster."""
    counts = values.groupBy(*keys, "cluster", bin_of(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    one = counts.groupBy(*keys, "cluster").agg(F.collect_list(F.struct("bin", "n")).alias("h"))  # as many as there are bins
    drawn = one.withColumn("w", F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda b: poisson_one(seed, b, F.col("cluster"))))
    return _summed(drawn.select(*keys, "w", F.inline("h")), resamples, keys)


def alone(values: DataFrame, seed: str, resamples: int = RESAMPLES, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, b, bin, w) on resamples of single values."""
    counts = values.groupBy(*keys, bin_of(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("bin") == float("inf"), "inf").otherwise(F.col("bin").cast("bigint").cast("string"))
    return counts.select(*keys, "bin", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda b: poisson(F.col("n"), seed, b, name))).alias("b", "w"))


def resampled_percentiles(weighted: DataFrame, percentiles: Sequence[int] = PERCENTILES, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, b, p50, ...): on each resample the least bin up to which that share of the weight lies; a resample without weight is absent."""
    by, whole = Window.partitionBy(*keys, "b").orderBy("bin"), Window.partitionBy(*keys, "b")
    sums = weighted.where("w > 0").select(*keys, "b", "bin", F.sum("w").over(by).alias("upto"), F.sum("w").over(whole).alias("all"))
    return sums.groupBy(*keys, "b").agg(*[F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, F.col("bin"))).alias(f"p{p}") for p in percentiles])


def numbered(rows: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """``rows`` of different whole ``key`` with their place ``i`` in its order, from 0, and ``k``, how many there are. Only stretches' counts are put in order in one task.

    Small as they look to the planner, rows aren't broadcast: all of them would pass through the driver.
    """
    rows = rows.withColumn("_part", F.floor(F.col(key) / width))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("k"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return rows.withColumn("_within", within).join(placed.hint("shuffle_hash"), "_part").withColumn("i", F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def drawn(rows: DataFrame, seed: str, resamples: int = RESAMPLES) -> DataFrame:
    """(b, ..., w) of ``numbered`` rows: how often resample b draws each of them, as many draws as rows, by hash; rows that it doesn't draw are absent.

    Draws are made in all tasks, and each goes to the task of the row that it draws.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = rows.select("i", "k").repartition(parts, "i").select(F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"), "i", "k")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "i")), 1, 8), 16, 10).cast("bigint") % F.col("k")
    counts = slots.select("b", draw.alias("i")).repartition(parts, "i").groupBy("b", "i").agg(F.count(F.lit(1)).alias("w"))
    return counts.join(rows.drop("k").hint("shuffle_hash"), "i").drop("i")


def weighted_percentiles(weighted: DataFrame, percentiles: Sequence[int] = PERCENTILES, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, b, p50, ...) of ``weighted`` (keys, b, v, w), which is read twice: on each resample the least value up to which that share of the weight lies, exactly.

    Bins only tell where it is; of their values those of the bins found are put in order.
    """
    by = [*keys, "b"]
    binned = weighted.select(*by, bin_of(F.col("v")).alias("bin"), "v", "w")
    sums = binned.groupBy(*by, "bin").agg(F.sum("w").alias("_w")).select(*by, "bin", "_w", F.sum("_w").over(Window.partitionBy(*by).orderBy("bin")).alias("upto"), F.sum("_w").over(Window.partitionBy(*by)).alias("whole"))
    found = sums.select(*by, "bin", (F.col("upto") - F.col("_w")).alias("before"), "upto", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), (F.lit(p / 100) * F.col("whole")).alias("least")) for p in percentiles])).alias("x"))
    found = found.where((F.col("upto") >= F.col("x.least")) & (F.col("before") < F.col("x.least"))).select(*by, "bin", "before", "x.p", "x.least")
    near = binned.join(F.broadcast(found.select(*by, "bin").distinct()), [*by, "bin"]).groupBy(*by, "bin", "v").agg(F.sum("w").alias("_w"))  # as many bins as percentiles of resamples
    placed = near.withColumn("within", F.sum("_w").over(Window.partitionBy(*by, "bin").orderBy("v"))).join(F.broadcast(found), [*by, "bin"]).where(F.col("before") + F.col("within") >= F.col("least"))
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percentiles])


def intervals(per_resample: DataFrame, percentiles: Sequence[int] = PERCENTILES, keys: Sequence[str] = ()) -> DataFrame:
    """Low and high of each percentile over the resamples; an upper end may be infinite."""
    q = lambda p, share: F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY p{p})")
    return per_resample.groupBy(*keys).agg(*[c for p in percentiles for c in (q(p, 0.025).alias(f"low{p}"), q(p, 0.975).alias(f"high{p}"))])


def exact_percentiles(values: DataFrame, percentiles: Sequence[int] = PERCENTILES, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, p50, ...): the least value up to which that share of all lies, without sorting all in one task.

    The bins' counts tell in which bin each percentile is; only these bins' values are counted and put in order.
    """
    keys = list(keys)
    binned = values.select(*keys, bin_of(F.col("v")).alias("bin"), "v")
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_k"))
    group = keys or [F.lit(1)]
    upto, n = F.sum("_k").over(Window.partitionBy(*group).orderBy("bin")), F.sum("_k").over(Window.partitionBy(*group))  # a row a bin
    sums = counts.select(*keys, "bin", "_k", upto.alias("upto"), n.alias("n"))
    wanted = sums.select(*keys, "bin", (F.col("upto") - F.col("_k")).alias("before"), "upto", "n", F.explode(F.array(*map(F.lit, percentiles))).alias("p")).where((F.col("upto") * 100 >= F.col("n") * F.col("p")) & (F.col("before") * 100 < F.col("n") * F.col("p")))
    near = binned.join(F.broadcast(wanted.select(*keys, "bin").distinct()), [*keys, "bin"]).groupBy(*keys, "bin", "v").agg(F.count(F.lit(1)).alias("_k"))  # as many bins as percentiles of groups
    placed = near.withColumn("within", F.sum("_k").over(Window.partitionBy(*keys, "bin").orderBy("v")))
    found = placed.join(F.broadcast(wanted), [*keys, "bin"]).where((F.col("before") + F.col("within")) * 100 >= F.col("n") * F.col("p"))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percentiles])


def latency_intervals(values: DataFrame, resamples: int = RESAMPLES, seeds: tuple[str, str] = ("8", "9"), keys: Sequence[str] = ()) -> DataFrame:
    """A row for each group of ``values`` (keys, cluster, v), or one: n, timeouts, speakers, percentiles with intervals over clusters, and how much wider the
    median's interval is than one over single values (null where either has no width or is infinite). Keys aren't null. ``values`` is read several times."""
    keys = list(keys)
    wide = intervals(resampled_percentiles(clustered(values, seeds[0], resamples, keys), keys=keys), keys=keys)
    narrow = intervals(resampled_percentiles(alone(values, seeds[1], resamples, keys), (50,), keys), (50,), keys).withColumnsRenamed({"low50": "l", "high50": "h"})
    counts = values.groupBy(*keys, "cluster").agg(F.count_if(F.col("v") == float("inf")).alias("t")).groupBy(*keys).agg(F.coalesce(F.sum("t"), F.lit(0)).alias("timeouts"), F.count(F.lit(1)).alias("speakers"))
    effect = F.when((F.col("high50") < float("inf")) & (F.col("h") < float("inf")) & (F.col("h") > F.col("l")), F.round((F.col("high50") - F.col("low50")) / (F.col("h") - F.col("l")), 8))
    one = exact_percentiles(values, keys=keys)
    for other in (counts, wide, narrow):  # a row a group each
        one = one.join(other, keys) if keys else one.crossJoin(other)
    return one.select(*keys, "n", "timeouts", "speakers", *[c for p in PERCENTILES for c in (f"p{p}", f"low{p}", f"high{p}")], effect.alias("cluster_effect"))
