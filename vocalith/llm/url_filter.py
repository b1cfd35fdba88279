"""URL filter: host and path rules, and for the rest two character Markov models of variable order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.llm.common import cut, discard, table

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Characters of context that the models look back at most.
ORDER = 5
#: Parts that the different labelled URLs are dealt into by hash: a part's URLs set the threshold with scores from counts without that part.
HELD_OUT = 5
#: Probability of a character before any is seen.
FLOOR = 1 / 1024
#: Different n-grams that a task counts before it passes them on.
BATCH = 500_000
START, END = "\x02", "\x03"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null where none fits. The list of rules is short: one CASE."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def grams(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, allow, block): how often each character with up to ``order`` before it stands in the URLs (url, verdict, part) of each class.

    ``allow`` and ``block`` are arrays: at ``part`` the count without that part's URLs, at HELD_OUT that of all. Tasks count before the
    shuffle. The table has a row for each different n-gram, grows with the URLs and never leaves the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for part in range(HELD_OUT):
                a, b = counts[part, "allow"], counts[part, "block"]
                keys = list(a.keys() | b.keys())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([part] * len(keys), pa.int32()), *(pa.array([n[k] for k in keys], pa.int64()) for n in (a, b))], ["gram", "part", "allow", "block"])

        counts = {(part, c): Counter() for part in range(HELD_OUT) for c in ("allow", "block")}
        for x in batches:
            for url, verdict, part in zip(x.column(0), x.column(1).to_pylist(), x.column(2).to_pylist()):
                t, n = START + url.as_py() + END, counts[part, verdict]
                for a in range(1, len(t), 10_000):
                    n.update(t[i - k : i + 1] for i in range(a, min(a + 10_000, len(t))) for k in range(min(order, i) + 1))
                    if sum(map(len, counts.values())) > BATCH:
                        yield from out()
                        for c in counts.values():
                            c.clear()
        yield from out()

    found = labelled.select("url", "verdict", "part").mapInArrow(run, "gram string, part int, allow bigint, block bigint")
    without = lambda c: F.array(*[F.sum(F.when(F.col("part") == k, 0).otherwise(F.col(c))) for k in range(HELD_OUT)], F.sum(c))
    return found.groupBy("gram").agg(without("allow").alias("allow"), without("block").alias("block"))


def values(windows: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(part, window, value) of different ``windows`` (part, window), characters with their contexts: the logarithm of the character's
    probability among accepted URLs, less that among rejected ones, in the counts without ``part``, or in all where that is HELD_OUT.

    Each order's counts are interpolated with the next shorter one's (Witten-Bell), from a uniform distribution up to the longest
    context that the class has, so every character has a probability and unseen contexts fall back by themselves.
    """
    context = lambda g: F.substring(g, F.lit(1), F.length(g) - 1)
    each = lambda x: F.array(*[x(k) for k in range(HELD_OUT + 1)])
    sums = [x for c in ("allow", "block") for x in (each(lambda k: F.sum(F.col(c)[k])).alias(f"{c}_all"), each(lambda k: F.count_if(F.col(c)[k] > 0)).alias(f"{c}_kinds"))]
    totals = counts.groupBy(context(F.col("gram")).alias("context")).agg(*sums)
    whole = counts.where(F.length("gram") == 1).agg(*sums).first()
    w = windows.select("part", "window", F.explode(F.sequence(F.lit(1), F.length("window"))).alias("n")).withColumn("gram", F.substring("window", F.length("window") - F.col("n") + 1, F.col("n")))
    # every window has the empty context, whose sums are one row: it takes that row from here, and a key of its own
    w = w.withColumn("context", F.when(F.col("n") == 1, F.concat(F.lit("\0"), "window")).otherwise(context(F.col("gram"))))
    own = lambda *names: {c: F.get(c, F.col("part")) for c in names}
    w = w.join(counts, "gram", "left").drop("gram").withColumns(own("allow", "block")).join(totals, "context", "left").withColumns(own(*totals.columns[1:]))
    w = w.withColumns({c: F.when(F.col("n") == 1, F.get(F.array(*[F.lit(x) for x in whole[c]]), F.col("part"))).otherwise(F.col(c)) for c in totals.columns[1:]})
    level = F.struct("n", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("allow", "allow_all", "allow_kinds", "block", "block_all", "block_kinds")])
    levels = w.groupBy("part", "window").agg(F.array_sort(F.collect_list(level)).alias("levels"))

    def chance(c: str) -> Column:
        return F.aggregate("levels", F.lit(FLOOR), lambda p, x: F.when(x[f"{c}_all"] > 0, (x[c] + x[f"{c}_kinds"] * p) / (x[f"{c}_all"] + x[f"{c}_kinds"])).otherwise(p))

    return levels.select("part", "window", (F.ln(chance("allow")) - F.ln(chance("block"))).alias("value"))


def scores(urls: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(_row, score) of ``urls`` (_row, part, url): the mean value of a URL's characters in the counts without ``part``. Each different window of a URL is one row on its way to its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), 1000):
                rows, parts, found, times = [], [], [], []
                for row, part, url in zip(*(b.column(i).slice(a, 1000).to_pylist() for i in range(3))):
                    t = START + url + END
                    n = Counter(t[max(0, i - order) : i + 1] for i in range(1, len(t)))
                    rows += [row] * len(n)
                    parts += [part] * len(n)
                    found += n.keys()
                    times += (k / (len(t) - 1) for k in n.values())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(parts, pa.int32()), pa.array(found, pa.string()), pa.array(times, pa.float64())], ["_row", "part", "window", "times"])

    seen = cut(urls.select("_row", "part", "url").mapInArrow(run, "_row bigint, part int, window string, times double"), "url-windows")
    value = cut(values(seen.select("part", "window").distinct(), counts, order), "url-values")
    found = cut(seen.join(value, ["part", "window"]).groupBy("_row").agg(F.round(F.sum(F.col("times") * F.col("value")), 9).alias("score")), "url-scores")
    discard(seen, value)
    return found


def calibrate(accepted: Sequence[float], rejected: Sequence[float]) -> float:
    """The score that splits the two best, both classes weighing the same; 0 where a class is missing. ``threshold`` has it for tables."""
    if not accepted or not rejected:
        return 0.0
    marks = sorted([(s, 1) for s in accepted] + [(s, 0) for s in rejected])
    right, best, at = 0, 0, marks[0][0]
    for i, (s, kind) in enumerate(marks):
        right += len(accepted) if kind == 0 else -len(rejected)
        if right > best and marks[i + 1][0] > s:  # after the last, as many are right as before the first
            best, at = right, (s + marks[i + 1][0]) / 2
    return at


def threshold(marks: DataFrame) -> float:
    """What ``calibrate`` gives for all of ``marks`` (verdict, score), however many: sums within ranges of scores, shifted by the ranges before.

    One row a range goes through a single task, and one row comes to the driver.
    """
    kinds = ("allow", "block")
    tally = cut(marks.groupBy("score").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in kinds]), "url-tally")
    dealt = cut(tally.repartitionByRange("score").withColumn("_range", F.spark_partition_id()), "url-ranges")
    least, allow, block = dealt.agg(F.min("score"), *[F.sum(v) for v in kinds]).first()
    if not allow or not block:
        discard(tally, dealt)
        return 0.0
    ranges = Window.orderBy("_range")  # over a row a range
    start = dealt.groupBy("_range").agg(F.min("score").alias("_low"), *[F.sum(v).alias(v) for v in kinds])
    start = start.select("_range", F.lead("_low").over(ranges).alias("_next"), *[F.coalesce(F.sum(v).over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{v}") for v in kinds])
    within = Window.partitionBy("_range").orderBy("score")
    below = {v: (F.col(f"_{v}") + F.sum(v).over(within.rowsBetween(Window.unboundedPreceding, 0))).cast("decimal(18,0)") for v in kinds}
    right = below["block"] * F.lit(allow).cast("decimal(18,0)") - below["allow"] * F.lit(block).cast("decimal(18,0)")
    splits = dealt.join(F.broadcast(start), "_range").select((-right).alias("wrong"), "score", F.coalesce(F.lead("score").over(within), "_next").alias("next"))
    best = splits.agg(F.min(F.struct("wrong", "score", "next"))).first()[0]
    discard(tally, dealt)
    return (best["score"] + best["next"]) / 2 if best["wrong"] < 0 else least


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, crossed: bool = False, key: str = "page_id", url: str = "url") -> DataFrame:
    """Host, path, rule and verdict of every URL, with ``score`` where no rule fits.

    The models learn from all different URLs that rules decide, dealt into HELD_OUT parts by hash. With ``crossed``, the counts take in all of
    them, and all set the threshold, from which on a URL is allowed that no rule decides: for that, each is scored by counts without its own part.
    Without, the first part is kept from the counts, and all of it sets the threshold. Counts and scores stay in tables; the threshold
    alone comes to the driver. A
    URL that is null, empty or without ``://`` has an empty host and path, which no rule fits; null and
    empty score 0. Without labelled URLs of both classes the threshold is 0, and an empty table gives no rows. Whole URLs are counted and scored,
    however long. Rows are judged one by one, so repeated rows agree; other columns are left out, whatever their names.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("page_id"), F.col(url).alias("url"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    rows = cut(rows.withColumn("rule", rule).withColumn("verdict", verdict), "url-rows")
    labelled = rows.where("rule IS NOT NULL").select("url", "verdict").distinct().withColumn("part", F.pmod(F.xxhash64("url", F.lit("held")), F.lit(HELD_OUT)).cast("int"))
    # dealt over all cores, as these few bytes are much work
    labelled = cut(labelled.repartition(2 * pages.sparkSession.sparkContext.defaultParallelism).withColumn("_row", -F.monotonically_increasing_id() - 1), "url-labelled")
    counts = cut(grams(labelled), "url-grams")
    known = labelled if crossed else labelled.where("part = 0")
    asked = rows.where("rule IS NULL AND url <> ''").select("_row", F.lit(HELD_OUT if crossed else 0).alias("part"), "url").union(known.select("_row", "part", "url"))
    found = scores(asked, counts)
    at = threshold(known.join(found, "_row").select("verdict", "score"))
    discard(counts, labelled)
    out = rows.join(found.where("_row >= 0"), "_row", "left").withColumn("score", F.when(F.col("rule").isNull(), F.coalesce("score", F.lit(0.0))))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("score") >= at, "allow").otherwise("block")).alias("verdict"), "score")


def op2_url_ratio_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), crossed=True)
