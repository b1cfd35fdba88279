"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.llm.common import cut, small_enough, spare_name, table, unit_interval

#: Words are what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Fractional documents that one reduction step combines, on average, and those of each size that a source keeps for the root.
FAN, RESERVE = 64, 32
#: Orders of chance of which the root takes the one that comes nearest to a source's target.
TRIES = 16
#: Plans up to this many rows are broadcast to the documents, larger ones joined by shuffle.
BROADCAST_PLAN = 200_000
#: A table of sources up to this many rows is broadcast, a larger one is joined by shuffle.
BROADCAST_SOURCES = 50_000
NEAR = 1e-9

_ITEM = "struct<doc_id:bigint,size:bigint,n:bigint,copies:bigint>"
_STATE = f"struct<open:boolean,item:{_ITEM},p:double,done:array<struct<item:{_ITEM},take:int>>>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with each source's place ``_i`` among all by name, from 0, null last: ranks within ranges of names, shifted by the ranges before."""
    name = F.col("source").asc_nulls_last()
    dealt = cut(sizes.repartitionByRange(name).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    start = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row = F.row_number().over(Window.partitionBy("_range").orderBy(name))
    return dealt.join(F.broadcast(start), "_range").withColumn("_i", F.col("_start") + row - 1).drop("_range", "_start")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Each source's target: its weight's share of all sizes, at most ``cap`` times its own, the excess reshared by weight.

    ``sizes`` has a row per source (source, source_size). Sources whose share of the words is above their cap are set to it, and
    what they leave is shared among the others, until none is above: one sum over the sources for each round.
    """
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    s = _ranked(sizes).withColumn("_w", F.element_at(kinds, (F.pmod("_i", F.lit(len(weights))) + 1).cast("int")))
    s = cut(s.withColumn("_cap", F.col("source_size") * float(cap)).drop("_i"), "mix-shares")
    level, over = F.lit(0.0), -1
    while True:
        above = F.col("_cap") < level * F.col("_w") - NEAR if over >= 0 else F.lit(False)
        r = s.agg(F.sum(F.when(above, F.col("_cap"))).alias("cap"), F.sum(F.when(~above, F.col("_w"))).alias("w"), F.sum("source_size").alias("all"), F.count_if(above).alias("n")).first()
        if r["n"] == over or not r["w"]:
            level = level if r["w"] else F.lit(float("inf"))
            break
        level, over = F.lit(float((r["all"] or 0) - (r["cap"] or 0.0)) / r["w"]), r["n"]
    return s.select("source", "source_size", F.least(F.col("_cap"), level * F.col("_w")).alias("target"))


def _let(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


def _whole(p: Column) -> Column:
    return (p < NEAR) | (p > 1 - NEAR)


def _meet(st: Column, x: Column, seed: int) -> Column:
    """The open document of ``st`` meets ``x``: words' mass moves one way or the other, at odds that keep both expectations,
    until one copy probability is 0 or 1. The two documents' expected words together stay the same."""
    s, t = x["item"]["size"].cast("double"), st["item"]["size"].cast("double")
    p, q = x["p"], st["p"]
    moves = F.struct(
        F.least((1 - q) * t, p * s).alias("into"),
        F.least(q * t, (1 - p) * s).alias("out"),
        unit_interval(st["item"]["doc_id"], st["item"]["size"], x["item"]["doc_id"], x["item"]["size"], F.lit(seed)).alias("u"),
    )

    def after(m: Column) -> Column:
        moved = F.when(m["u"] * (m["into"] + m["out"]) < m["out"], m["into"]).otherwise(-m["out"])
        return _let(moved, lambda d: F.struct((q + d / t).alias("q"), (p - d / s).alias("p")))

    def settle(r: Column) -> Column:
        none = F.array().cast(f"array<struct<item:{_ITEM},take:int>>")
        fixed = lambda item, v: F.when(_whole(v), F.array(F.struct(item.alias("item"), F.round(v).cast("int").alias("take")))).otherwise(none)
        return F.struct(
            (~(_whole(r["q"]) & _whole(r["p"]))).alias("open"),
            F.when(_whole(r["q"]), x["item"]).otherwise(st["item"]).alias("item"),
            F.when(_whole(r["q"]), r["p"]).otherwise(r["q"]).alias("p"),
            F.concat(st["done"], fixed(st["item"], r["q"]), fixed(x["item"], r["p"])).alias("done"),
        ).cast(_STATE)

    start = F.struct(F.lit(True).alias("open"), x["item"].alias("item"), p.alias("p"), st["done"].alias("done")).cast(_STATE)
    return F.when(~st["open"], start).otherwise(_let(moves, lambda m: _let(after(m), settle)))


def _reduce(nodes: DataFrame, seed: int, tag: str) -> DataFrame:
    """One level of the tree: (source, kind, block, st), every block's documents settled but one at most. Larger documents meet first."""
    empty = F.struct(F.lit(False).alias("open"), F.lit(None).cast(_ITEM).alias("item"), F.lit(0.0).alias("p"), F.array().alias("done")).cast(_STATE)
    met = nodes.groupBy("source", "kind", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("item.size")).alias("order"), "item", "p"))).alias("xs"))
    return cut(met.select("source", "kind", "block", F.aggregate("xs", empty, lambda st, x: _meet(st, x, seed)).alias("st")), tag)


_CHAIN = "struct<a:double,b:double,down:double,up:double,off:double,takes:array<bigint>>"


def _settle(st: Column, x: Column, seed: Column) -> Column:
    """The next largest document of a source meets the pool of all smaller ones: words move between them until the document's
    copies are whole, at odds that keep its expectation if the pool can take either way, and the way that it can take if not.

    The pool's documents move in step: ``a`` x most + ``b`` x copies are a document's copies now, between 0 and its most. ``down`` and ``up`` are
    words that the pool can give and take, and ``off`` those that it couldn't.
    """
    now = st["a"] * x["most"] + st["b"] * x["x"]

    def decided(m: Column) -> Column:
        low = F.floor(m["x"] + NEAR)
        rest = F.greatest(m["x"] - low, F.lit(0.0))
        up = (x["size"] * (1 - rest) <= m["down"] + NEAR) & (low + 1 <= x["most"])
        down = x["size"] * rest <= m["up"] + NEAR
        chance = F.when(rest < NEAR, 0.0).when(up & down, rest).when(up, 1.0).when(down, 0.0).otherwise(F.when((rest >= 0.5) & (low + 1 <= x["most"]), 1.0).otherwise(0.0))
        u = unit_interval(x["doc_id"], x["size"], seed)
        return F.struct((low + F.when(u < chance, 1).otherwise(0)).cast("long").alias("take"), m["x"].alias("x"), m["down"].alias("down"), m["up"].alias("up"))

    def after(r: Column) -> Column:
        owed = (r["x"] - r["take"]) * x["size"]
        moved = F.greatest(F.least(owed, r["up"]), -r["down"])
        share = F.when(moved > 0, moved / r["up"]).when(moved < 0, -moved / r["down"]).otherwise(0.0)
        return _let(F.struct(owed.alias("owed"), moved.alias("moved"), share.alias("share")), lambda q: F.struct(
            (st["a"] * (1 - q["share"]) + F.when(q["moved"] > 0, q["share"]).otherwise(0.0)).alias("a"), (st["b"] * (1 - q["share"])).alias("b"),
            (r["down"] + q["moved"]).alias("down"), (r["up"] - q["moved"]).alias("up"), (st["off"] + q["owed"] - q["moved"]).alias("off"), F.concat(st["takes"], F.array(r["take"])).alias("takes"),
        ).cast(_CHAIN))

    pool = F.struct(now.alias("x"), F.greatest(st["down"] - x["size"] * now, F.lit(0.0)).alias("down"), F.greatest(st["up"] - x["size"] * (x["most"] - now), F.lit(0.0)).alias("up"))
    return _let(pool, lambda m: _let(decided(m), after))


def _chain(items: DataFrame, seed: int, rest: DataFrame | None = None) -> DataFrame:
    """(source, st, xs) of sources' ``items`` (source, item, x, most), settled from the largest down: of TRIES orders of chance the one that comes
    nearest. ``rest`` (source, down, up) has words that documents which aren't among the items can give and take."""
    order = F.struct((-F.col("item.size")).alias("order"), F.xxhash64("item.doc_id", F.lit(seed)).alias("h"), "item", "x", "most")
    xs = items.groupBy("source").agg(F.sort_array(F.collect_list(order)).alias("xs"), F.sum(F.col("item.size") * F.col("x")).alias("down"), F.sum(F.col("item.size") * (F.col("most") - F.col("x"))).alias("up"))
    if rest is not None:
        more = rest.toDF("_source", "_down", "_up")
        xs = xs.join(more, F.col("source").eqNullSafe(F.col("_source"))).withColumns({"down": F.col("down") + F.col("_down"), "up": F.col("up") + F.col("_up")})
    flat = F.transform("xs", lambda x: F.struct(x["item"]["doc_id"].alias("doc_id"), x["item"]["size"].cast("double").alias("size"), x["x"].alias("x"), x["most"].alias("most")))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.col("down").cast("double"), F.col("up").cast("double"), F.lit(0.0).alias("off"), F.array().alias("takes")).cast(_CHAIN)
    tried = xs.withColumn("try", F.explode(F.sequence(F.lit(seed), F.lit(seed + TRIES - 1)))).select("source", "try", F.aggregate(flat, start, lambda st, x: _settle(st, x, F.col("try"))).alias("st"))
    best = tried.groupBy("source").agg(F.min_by("st", F.struct(F.round(F.abs("st.off"), 6), "try")).alias("st")).withColumnRenamed("source", "_s")
    return xs.join(best, F.col("source").eqNullSafe(F.col("_s"))).select("source", "st", "xs")


def _taken(chain: DataFrame) -> DataFrame:
    return chain.select("source", F.explode(F.zip_with("xs", "st.takes", lambda x, t: F.struct(x["item"].alias("item"), t.alias("total")))).alias("d")).select("source", "d.item", "d.total")


def decide(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Copies of every document such that each source's words come near its target: (source, doc_id, size, source_size, target, n, total).

    A row stands for ``n`` rows that agree in source, doc_id and size; ``total`` is their copies together. Expected copies
    are target / source size; equal rows share out whole copies at once, which leaves one fraction a row. Fractions of documents of one
    source and about one size (a power of two) are rounded in blocks of about FAN, and the block's one open document goes up a tree
    of the same steps. A sample of about RESERVE documents of each size, or all if there are few, is kept for the root: there the largest documents are settled first,
    and what they take or leave is made up for by the smaller ones, within 0 and ``cap`` copies. Documents of a size that few have, larger than one that many have,
    are settled before the tree, which then makes up for them. A source misses its target by about half of its smallest
    documents, unless these are too few words to make up for the larger ones. Hashes of the ids stand for chance: reruns agree.

    Null text: size 0; null source: a source of its own, sorted last; null ids are ids. Documents without words get the whole part
    of their expected copies. Whole texts are counted, however long. An empty table gives no rows; other columns are left out, whatever
    their names. ``cap`` is a whole number.
    """
    if cap != int(cap):
        raise ValueError("cap is a whole number of copies")
    units = docs.select(F.col(source).alias("source"), F.col(doc_id).cast("long").alias("doc_id"), words(F.col(text)).alias("size"))
    units = cut(units.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "mix-units")
    kind = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size") + 0.5)).cast("int")).otherwise(-1)
    kinds = cut(units.groupBy("source", kind.alias("kind")).agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count(F.lit(1)).alias("docs")), "mix-kinds")
    aim = cut(targets(kinds.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap), "mix-targets").withColumnRenamed("source", "_source")
    on = F.col("source").eqNullSafe(F.col("_source"))
    some, many = F.col("kind") >= 0, (F.col("kind") >= 0) & (F.col("docs") > 2 * RESERVE)
    least = kinds.groupBy("source").agg(F.min(F.when(many, F.col("kind"))).alias("_least")).withColumnRenamed("source", "_s")
    aims = kinds.join(aim, on).join(least, F.col("source").eqNullSafe(F.col("_s"))).withColumn("large", F.coalesce(some & ~many & (F.col("kind") > F.col("_least")), F.lit(False)))
    aims = cut(aims.select(F.col("source").alias("_source"), F.col("kind").alias("_kind"), "words", "docs", "source_size", "target", "large"), "mix-aims")
    side = F.broadcast(aims) if small_enough(aims, BROADCAST_SOURCES) else aims

    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = units.withColumn("kind", kind).join(side, on & (F.col("kind") == F.col("_kind"))).drop("_source", "_kind", "words")
    u = u.withColumns({"x": F.col("n") * each, "most": F.col("n") * float(cap)})
    item = F.struct("doc_id", "size", "n", F.lit(0).alias("copies")).cast(_ITEM)
    settled = []
    if aims.where("large").limit(1).count():
        rest = aims.groupBy("_source").agg(F.sum(F.when(~F.col("large"), F.col("words"))).alias("w"), F.first(each).alias("e"))
        rest = rest.select("_source", F.col("w") * F.col("e"), F.col("w") * (float(cap) - F.col("e")))
        chain = cut(_chain(u.where("large").select("source", item.alias("item"), "x", "most"), seed, rest), "mix-large")
        settled.append(_taken(chain))
        moved = chain.select(F.col("source").alias("_source"), F.col("st.a").alias("_a"), F.col("st.b").alias("_b"))
        u = u.where("NOT large").join(F.broadcast(moved) if small_enough(moved, BROADCAST_SOURCES) else moved, on, "left").drop("_source")
        u = u.withColumn("x", F.coalesce(F.col("_a") * F.col("most") + F.col("_b") * F.col("x"), F.col("x"))).drop("_a", "_b")
    u = u.withColumn("copies", F.floor(F.col("x") + NEAR).cast("long")).withColumn("p", F.greatest(F.col("x") - F.col("copies"), F.lit(0.0)))
    item = F.struct("doc_id", "size", "n", "copies").cast(_ITEM)
    kept = (F.col("docs") <= 2 * RESERVE) | (unit_interval(F.col("doc_id"), F.col("size"), F.lit(seed)) * F.col("docs") < RESERVE)
    u = u.select("source", "kind", "docs", item.alias("item"), "x", "p", (F.col("size") > 0).alias("some"), kept.alias("kept"))
    root = [u.where("some AND kept").select("source", "item", "x")]
    whole = F.col("p") <= NEAR
    settled.append(u.where(~F.col("some") | (~F.col("kept") & whole)).select("source", "item", F.col("item.copies").alias("total")))
    top = kinds.where("kind >= 0").agg(F.max(F.ceil(F.when(F.col("docs") > 2 * RESERVE, F.col("docs")) / FAN))).first()[0]
    if top:
        place = F.floor(unit_interval(F.col("item.doc_id"), F.col("item.size")) * F.ceil(F.col("docs") / FAN)).cast("long")
        nodes = u.where(F.col("some") & ~F.col("kept") & ~whole).select("source", "kind", place.alias("block"), "item", "p")
        level = 0
        while True:
            step = _reduce(nodes, seed + level, f"mix-level{level}")
            done = step.select("source", F.explode("st.done").alias("d"))
            settled.append(done.select("source", "d.item", (F.col("d.item.copies") + F.col("d.take")).alias("total")))
            left = step.where("st.open").select("source", "kind", "block", F.col("st.item").alias("item"), F.col("st.p").alias("p"))
            if top <= 1:
                root.append(left.select("source", "item", (F.col("item.copies") + F.col("p")).alias("x")))
                break
            nodes = left.withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
            top = -(-top // FAN)
            level += 1
    settled.append(_taken(cut(_chain(reduce(DataFrame.union, root).withColumn("most", F.col("item.n") * float(cap)), seed), "mix-root")))
    out = reduce(DataFrame.union, settled).select("source", "item.doc_id", "item.size", "item.n", "total")
    per = F.broadcast(aim) if small_enough(aim, BROADCAST_SOURCES) else aim
    return out.join(per, on, "left").drop("_source")


def expand(decided: DataFrame) -> DataFrame:
    """A row for each document, with its own ``copies`` and ``taken`` words; equal rows' copies differ by one at most."""
    d = decided.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    d = d.withColumn("copies", (F.floor(F.col("total") / F.col("n")) + F.when(F.col("_i") < F.col("total") % F.col("n"), 1).otherwise(0)).cast("long"))
    return d.withColumn("taken", F.col("copies") * F.col("size"))


def _shared_out(repeated: DataFrame) -> DataFrame:
    """Rows that are one row of the plan, each with its ``_m_copies``: numbered within the tasks that wrote them, one after the other."""
    key = ["_m_source", "_m_doc", "_m_size"]
    rows = cut(repeated.withColumn("_m_task", F.spark_partition_id()), "mix-repeated")
    counts = rows.groupBy(*key, "_m_task").agg(F.count(F.lit(1)).alias("_m_k"))
    before = F.sum("_m_k").over(Window.partitionBy(*key).orderBy("_m_task")) - F.col("_m_k")  # a row a task
    start = counts.select(*[F.col(c).alias(f"{c}_") for c in (*key, "_m_task")], before.alias("_m_before"))
    i = F.row_number().over(Window.partitionBy(*key, "_m_task").orderBy(F.xxhash64("text")))
    rows = rows.withColumn("_m_i", i)
    on = [rows[c].eqNullSafe(start[f"{c}_"]) for c in (*key, "_m_task")]
    rows = rows.join(F.broadcast(start) if small_enough(start, BROADCAST_PLAN) else start, on)
    whole, rest = F.floor(F.col("_m_total") / F.col("_m_n")), F.col("_m_total") % F.col("_m_n")
    return rows.withColumn("_m_copies", (whole + F.when(F.col("_m_before") + F.col("_m_i") <= rest, 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = 7) -> DataFrame:
    """The mixed table: the rows of ``docs`` (doc_id, text, source and any other columns), each as often as ``decide`` says."""
    decided = cut(decide(docs, weights, cap, seed).select("source", "doc_id", "size", "n", "total").where("total > 0"), "mix-plan")
    size, ids = spare_name(docs, "_mix_size"), docs["doc_id"].cast("long")
    d = decided.toDF("_m_source", "_m_doc", "_m_size", "_m_n", "_m_total")
    sized = docs.withColumn(size, words(F.col("text")))
    on = sized["doc_id"].cast("long").eqNullSafe(d["_m_doc"]) & sized["source"].eqNullSafe(d["_m_source"]) & (sized[size] == d["_m_size"])
    both = sized.join(F.broadcast(d) if small_enough(decided, BROADCAST_PLAN) else d, on)
    rows = both.where("_m_n = 1").withColumn("_m_copies", F.col("_m_total"))
    if decided.where("n > 1").limit(1).count():
        rows = rows.union(_shared_out(both.where("_m_n > 1")).select(*rows.columns))
    names = [F.col(f"`{c}`") for c in docs.columns]
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m_copies")))
    return rows.where("_m_copies > 0").select(*names, copies.alias("_m_copy")).drop("_m_copy")


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expand(decide(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
