"""Filter interaction audit: what each filter removes in every order of the filters, from joint failures alone.

For every set of filters one sum of flag products counts the rows that fail all of it. Survivors of a set, failures of one filter alone and
Shapley values follow by inclusion and exclusion (Möbius inversion over the sets), without looking at the rows again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.llm.common import table

WORD = r"[^\x20\x09-\x0D]+"
#: Bounds of the filters: words, percent of different words, percent of capitals.
WORDS, DIFFERENT, CAPITALS = 200, 50, 3
MARKS = "[#$%&*|]"


def joint_failures(flagged: DataFrame, part: str, flags: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """One row a part: for each weight an array, under the weight's name, whose item s is the weight of the rows that fail every filter of set s.

    Bit i of s stands for ``flags[i]``, of value 0 or 1; item 0 is the weight of all rows. Sums are made in each task first, so a
    part may hold any share of the rows.
    """
    sets = range(1 << len(flags))
    product = lambda w, s: " * ".join([w, *(f for i, f in enumerate(flags) if s >> i & 1)])
    sums = [F.expr(f"sum({product(w, s)}) AS {w}_{s}") for w in weights for s in sets]
    return flagged.groupBy(part).agg(*sums).select(part, *[F.expr(f"array({', '.join(f'{w}_{s}' for s in sets)}) AS {w}") for w in weights])


def _combined(joint: str, factors: list[dict[int, int]]) -> Column:
    """An array with, for each of ``factors``, the sum of the items of ``joint`` times their factors."""
    return F.expr("array(" + ", ".join(" + ".join(f"{joint}[{s}] * {k}L" for s, k in x.items()) for x in factors) + ")")


def survivors(joint: str, filters: int) -> Column:
    """Item u: the weight of the rows that fail no filter of set u."""
    sets = range(1 << filters)
    return _combined(joint, [{s: -1 if s.bit_count() % 2 else 1 for s in sets if s & u == s} for u in sets])


def shapley(joint: str, filters: int) -> Column:
    """Item i: what filter i removes, summed over all orders of the filters.

    The game's worth of a set is what it removes; its Harsanyi dividends are the joint failures with the sign of inclusion and exclusion,
    and each is shared equally by its members.
    """
    dividends = {s: math.factorial(filters) // s.bit_count() * (1 if s.bit_count() % 2 else -1) for s in range(1, 1 << filters)}
    return _combined(joint, [{s: d for s, d in dividends.items() if s >> i & 1} for i in range(filters)])


def interactions(flagged: DataFrame, part: str, flags: Sequence[str], count: str, lost: dict[str, str]) -> DataFrame:
    """A row for each part, order of ``flags`` and step: kept, removed, redundant, unique_fails, the losses named in ``lost``, shapley.

    ``count`` is the number of rows that a row of ``flagged`` stands for; ``lost`` maps names of results to columns of weights. Parts come
    from ``flagged``, so an empty table gives no rows.
    """
    n, full = len(flags), (1 << len(flags)) - 1
    weights = [count, *lost.values()]
    joint = joint_failures(flagged, part, flags, weights)
    left = joint.select(part, F.col(count).alias("joint"), shapley(count, n).alias("shapley"), *[survivors(w, n).alias(f"left_{w}") for w in weights])
    steps = []
    for order in permutations(range(n)):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(flags[i] for i in order), k + 1, f, before, before | 1 << f))
            before |= 1 << f
    known = "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>"
    listed = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{k},"f":{f},"before":{b},"after":{a}}}' for o, k, f, b, a in steps) + "]"), known)
    rows = left.withColumn("at", F.explode(listed))
    at = lambda c, i: F.get(F.col(c), i)
    gone = lambda w: at(f"left_{w}", F.col("at.before")) - at(f"left_{w}", F.col("at.after"))
    bit = F.expr("shiftleft(1, at.f)")
    return rows.select(
        part,
        "at.filter_order",
        "at.step",
        at(f"left_{count}", F.col("at.after")).alias("kept"),
        gone(count).alias("removed"),
        (at("joint", bit) - gone(count)).alias("redundant"),
        (at(f"left_{count}", F.lit(full) - bit) - at(f"left_{count}", F.lit(full))).alias("unique_fails"),
        *[gone(w).alias(name) for name, w in lost.items()],
        at("shapley", F.col("at.f")).alias("shapley"),
    )


def _flags(text: Column) -> dict[str, Column]:
    """What a text fails by itself; ``text`` isn't null. Words are cut once, under the column ``w``."""
    w, n = F.col("w"), F.size("w")
    return {
        "A": n < WORDS,
        "B": 100 * F.size(F.array_distinct(w)) < DIFFERENT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITALS * F.char_length(text),
        "D": text.rlike(MARKS),
    }


def flagged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups of documents with equal part, text, labels and outcome: part, A to E as 0 or 1, n, good and toxic as numbers of rows.

    Texts count by their SHA-256 and only narrow rows move. Copies are added up before they meet, so a text may have any number of them. E fails
    unless the row's doc_id is the least of its text; a null doc_id is smaller than none, greater than none, and has no label. A document is
    good (toxic) if any of its labels says 1. Null texts are empty ones, a null lang is the empty string. Each repeated row counts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    alone = _flags(F.col("text"))
    rows = rows.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), *[f.cast("long").alias(name) for name, f in alone.items()])
    rows = rows.groupBy("part", "doc_id", "digest", *alone).agg(F.count(F.lit(1)).alias("rows"))
    told = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(name) for name, c in (("is_good", "quality"), ("is_toxic", "toxic"))])
    marks = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("is_good", "is_toxic")]
    rows = rows.join(told, "doc_id", "left").select("part", "doc_id", "digest", *alone, "rows", *marks)
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rows"))  # one row an id here, so the least struct has the least id's rows
    groups = rows.groupBy("digest", "part", *alone, "is_good", "is_toxic").agg(F.sum("rows").alias("rows"), F.min(named).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(0)).alias("nameless"))
    groups = groups.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))  # of a text there are a few groups a part
    # in a group, rows of the text's least id and those without an id pass E
    passing = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.rows")).otherwise(0)
    outcome = F.explode(F.array(*[F.struct(F.lit(e).cast("long").alias("E"), n.alias("n")) for e, n in ((0, passing), (1, F.col("rows") - passing))]))
    groups = groups.select("part", *alone, "is_good", "is_toxic", outcome.alias("o")).select("part", *alone, "o.E", "o.n", "is_good", "is_toxic").where("n > 0")
    return groups.select("part", *alone, "E", "n", (F.col("n") * F.col("is_good")).alias("good"), (F.col("n") * F.col("is_toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All 120 orders of the filters A to E over ``docs``: see ``flagged_documents`` for cases and ``interactions`` for columns.

    Other columns of either table, whatever their names, take no part; an empty table of documents gives no rows.
    """
    flagged = flagged_documents(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"))
    return interactions(flagged, "part", "ABCDE", "n", {"good_lost": "good", "toxic_lost": "toxic"})


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every order is gone through step by step over the numbers of documents that fail alike.
AUDIT_SQL = r"""WITH d AS (SELECT coalesce(cast(lang AS VARCHAR), '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 3 * length(d.t), regexp_matches(d.t, '[#$%&*|]'), coalesce(d.doc_id > first, false)] AS f,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d JOIN m ON d.t = m.t LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step FROM o, x),
r AS (SELECT part, o, step, sum(CASE WHEN NOT list_bool_or(list_transform(o[:step], lambda j: f[j])) THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN f[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda j: f[j])), false) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN f[o[step]] AND coalesce(list_bool_or(list_transform(o[:step - 1], lambda j: f[j])), false) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN f[o[step]] AND len(list_filter(f, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN f[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda j: f[j])), false) THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN f[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda j: f[j])), false) THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda j: 'ABCDE'[j]), '') AS filter_order, cast(step AS INT) AS step, cast(kept AS BIGINT) AS kept, cast(removed AS BIGINT) AS removed, cast(redundant AS BIGINT) AS redundant,
  cast(unique_fails AS BIGINT) AS unique_fails, cast(good_lost AS BIGINT) AS good_lost, cast(toxic_lost AS BIGINT) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley FROM r"""
