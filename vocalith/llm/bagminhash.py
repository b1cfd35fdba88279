"""Near-duplicate documents: BagMinHash signatures of word shingles, banding, and verified multiset overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm.common import components, cut, discard, small_enough, spare_name, table, text_batches, tidy

#: Words a shingle, the least similarity of a link, and bands x rows of the signature.
WORDS, LEAST, BANDS, ROWS = 5, 0.8, 26, 5
#: Bands that are compared before the others.
FIRST = 3
#: Members of a bucket's part on average, and their shingles with repeats; a task compares two parts at most.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
#: Shingles that are hashed at once, and words whose hashes a worker keeps.
BATCH, MEMO = 300_000, 100_000
#: Tables of ids up to this many rows are broadcast, larger ones joined by shuffle.
BROADCAST_IDS = 200_000
#: Rows of a text from which its class is broadcast to them, at least; of a table's texts, as many as BROADCAST_IDS at most have more than that share of it.
MANY_ROWS = 100

_U = np.uint64
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52


class Shingler(dict):
    """Texts to multisets of shingles: lower-cased words between white space, WORDS in a row, fewer in a shorter text."""

    def __init__(self, words: int = WORDS):
        super().__init__()
        self.words = words

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def bag(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The shingles' 64-bit hashes in order and how often each occurs."""
        w = (text or "").lower().split()
        h = np.fromiter(map(self.__getitem__, w), _U, len(w))
        k = min(self.words, len(h))
        if not k:
            return h, np.array([], np.int64)
        s = sum((h[i : len(h) - k + 1 + i] * _WEIGHTS[i] for i in range(k)), np.zeros(len(h) - k + 1, _U))
        s = np.sort(mix(s))
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        return s[first], np.diff(np.append(first, len(s)))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """BagMinHash of each bag: rows of ``registers`` values that agree with the probability of the weighted Jaccard similarity.

    An element of weight c carries Poisson points over the time-weight plane up to weight c. The weight axis is cut into
    dyadic intervals [0,1), [1,2), [2,4) ..., each a process of its own whose rate is its length, and an interval that c
    cuts through keeps the points below c: equal elements of two bags share all points below the smaller weight. Points
    come in the order of time, each on a random register, which keeps its earliest; an element stops once it is past
    the latest register of its bag. All bags advance together.
    """
    reg = np.full((len(bags), registers), np.inf)
    if not bags:
        return reg.view(_U)
    doc = np.repeat(np.arange(len(bags)), [len(g) for g, _ in bags])
    g, c = np.concatenate([x for x, _ in bags]), np.concatenate([x for _, x in bags])
    parts, low = [], 0
    while (here := c > low).any():
        width = max(low, 1)
        n = int(here.sum())
        parts.append((doc[here], mix(g[here] + np.full(1, low, _U) * _WEIGHTS[0]), np.full(n, float(low)), np.full(n, float(width)), c[here].astype(np.float64)))
        low += width
    doc, key, base, width, weight = (np.concatenate(x) for x in zip(*parts)) if parts else (np.array([], int),) * 5
    t, k, flat = np.zeros(len(doc)), 0, reg.reshape(-1)
    while len(doc):
        q = 1 if len(doc) > 50_000 else 4 if len(doc) > 8_000 else 16
        r = mix(key[:, None] + np.arange(k + 1, k + q + 1, dtype=_U) * _WEIGHTS[1])
        gaps = -np.log(uniform(r)) / (registers * width)[:, None]
        gaps[:, 0] += t
        times = np.cumsum(gaps, axis=1)
        r = mix(r + _WEIGHTS[2])
        at = doc[:, None] * registers + ((r >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
        inside = times <= reg.max(1)[doc][:, None]
        if (partial := base + width > weight).any():
            inside[partial] &= (base[partial, None] + width[partial, None] * uniform(mix(r[partial] + _WEIGHTS[3]))) < weight[partial, None]
        np.minimum.at(flat, at[inside], times[inside])
        t, k = times[:, -1], k + q
        going = t <= reg.max(1)[doc]
        doc, key, base, width, weight, t = (x[going] for x in (doc, key, base, width, weight, t))
    return mix(reg.view(_U))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 0 where both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    return mix((parts * _WEIGHTS[:rows]).sum(2) + np.arange(bands, dtype=_U) * _WEIGHTS[5]).view(np.int64)


def sign(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """(doc_id, node, bands, size) of every document: its text's digest, its band keys and its shingles, repeats counted.
    Texts without words have a null node and nothing else."""
    text_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)

        def done(ids: list, nodes: list, bags: list) -> pa.RecordBatch:
            sig = signatures(bags, bands * rows)
            keys, sizes = iter(band_keys(sig, bands, rows).tolist()), iter([int(c.sum()) for _, c in bags])
            keys = [None if n is None else next(keys) for n in nodes]
            sizes = [0 if n is None else next(sizes) for n in nodes]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], ["doc_id", "node", "bands", "size"])

        ids, nodes, bags, size = [], [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                bag = shingler.bag(t)
                ids.append(i)
                nodes.append(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() if len(bag[0]) else None)
                if len(bag[0]):
                    bags.append(bag)
                size += len(bag[0]) + 64
                if size > BATCH:
                    yield done(ids, nodes, bags)
                    ids, nodes, bags, size = [], [], [], 0
        if ids:
            yield done(ids, nodes, bags)

    return source.mapInArrow(lambda batches: tidy(run(batches)), "doc_id bigint, node binary, bands array<bigint>, size int")


def _buckets(held: DataFrame, block: int, shingles: int) -> DataFrame:
    """(key, p, q, node, root, part): members of the buckets (node, root, key, size) that hold texts of several classes, dealt into cells.

    Buckets of the same members are kept once. A bucket of more than ``block`` members or ``shingles`` is dealt into parts, and each pair
    of parts meets in the cell (p, q), so any number of members is compared whole in cells of bounded size; a text longer than that stands in a part nearly alone.
    """
    h = F.xxhash64("node")
    full = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 24)).alias("s"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum("size").alias("all"))
    once = full.where("low != high").groupBy("n", "x", "s").agg(F.min("key").alias("key"), F.min("all").alias("all")).select("key", F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("all") / shingles))).cast("int").alias("parts"))
    rows = held.join(once, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "node", "root", "part")


def shared(bags: list[tuple[np.ndarray, np.ndarray]], asking: np.ndarray) -> np.ndarray:
    """How many shingles, repeats counted, each asking bag shares with each bag: one column for each (shingle, k-th occurrence)
    that several bags have, and products of 0-1 matrices a bounded number of columns at a time."""
    parts, doc = [], np.repeat(np.arange(len(bags)), [int(c.sum()) for _, c in bags])
    for g, c in bags:
        first = np.repeat(np.cumsum(c) - c, c)
        parts.append(mix(np.repeat(g, c) + (np.arange(len(first)) - first).astype(_U) * _WEIGHTS[6]))
    h = np.concatenate(parts)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    column, doc = column[several], doc[several]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    out = np.zeros((len(asking), len(bags)), np.float32)
    wide = max(256, 4_000_000 // len(bags))
    ends = np.searchsorted(column, np.arange(wide, (column[-1] if len(column) else -1) + wide + 1, wide)) if len(column) else []
    at = 0
    for k, end in enumerate(ends):
        m = np.zeros((len(bags), wide), np.float32)
        m[doc[at:end], column[at:end] - k * wide] = 1
        out += m[asking] @ m.T
        at = end
    return out


def _link_cell(bags: list, roots: np.ndarray, part: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set (i, j) of all links between bags of different roots (across parts only, where given)."""
    kinds, which, sizes = np.unique(roots, return_inverse=True, return_counts=True)
    asking = np.flatnonzero(which != sizes.argmax())  # the largest class asks nothing: links go both ways
    low, got_i, got_j = np.arange(len(bags)), [], []
    total = np.array([c.sum() for _, c in bags])
    for a in range(0, len(asking), 256):
        i = asking[a : a + 256]
        both = shared(bags, i)
        ok = both >= least * (total[i][:, None] + total - both) - 1e-6
        ok &= which[i][:, None] != which
        if part is not None:
            ok &= part[i][:, None] != part
        x, y = np.nonzero(ok)
        got_i.append(i[x])
        got_j.append(y)
    i, j = (np.concatenate(x) if x else np.array([], int) for x in (got_i, got_j))
    while True:
        old = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        if (old == low).all():
            break
    moved = np.flatnonzero(low != np.arange(len(bags)))
    return moved, low[moved]


def _links(cells: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """(a, b): in every cell, links that connect all its texts that overlap by ``least`` and aren't connected yet."""

    def meet(t: pa.Table) -> pa.Table:
        nodes = t.column("node").to_pylist()
        both = [(np.frombuffer(g, _U), np.frombuffer(c, np.int32).astype(np.int64)) for g, c in zip(t.column("grams").to_pylist(), t.column("counts").to_pylist())]
        roots = np.unique(np.array([r.hex() for r in t.column("root").to_pylist()]), return_inverse=True)[1]
        across = np.array(t.column("part")) if t.column("p")[0] != t.column("q")[0] else None
        i, j = _link_cell(both, roots, across, least)
        return pa.table({"a": pa.array([nodes[k] for k in i], pa.binary()), "b": pa.array([nodes[k] for k in j], pa.binary())})

    return cells.join(bags, "node").groupBy("key", "p", "q").applyInArrow(meet, "a binary, b binary")


def _bags(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, grams, counts) of the ``wanted`` nodes' whole texts, as bytes of the sorted hashes and their counts."""
    ids = wanted.join(nodes.select("node", "doc_id"), "node").withColumnRenamed("doc_id", "_doc")
    ids = cut(ids.select("node", "_doc"), "bag-wanted")
    side = F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = rows.join(side, (F.col("_h") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.slice(a, 256)
                bags = [shingler.bag(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g.tobytes() for g, _ in bags], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in bags], pa.binary())], ["node", "grams", "counts"])

    bags = rows.mapInArrow(lambda batches: tidy(run(batches)), "node binary, grams binary, counts binary")
    return cut(bags.dropDuplicates(["node"]), "bag-texts")


def _with_class(rows: DataFrame, named: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (doc_id, node, ...) with what ``named`` (_n, n, class_id, n_class, best) has of their node.

    Texts with many rows have their class broadcast: they are as few as their share of all rows allows. The others' rows meet it by shuffle,
    where those that have found it are dealt out by their ids and meet nothing.
    """
    total = nodes.agg(F.sum("n")).first()[0] or 0
    own = ["class_id", "n_class", "best"]
    many = named.where(F.col("n") > max(MANY_ROWS, total // BROADCAST_IDS)).select("_n", *own).toDF("_m", *(f"_{c}" for c in own))
    rows = rows.join(F.broadcast(many), F.col("node") == F.col("_m"), "left")
    key = F.when(F.col("_m").isNotNull() | F.col("node").isNull(), F.unhex(F.sha1(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("row")).cast("binary")))).otherwise(F.col("node"))
    rows = rows.withColumn("_key", key).join(named.drop("n"), F.col("_key") == F.col("_n"), "left")
    return rows.select(*[c for c in rows.columns if c not in ("_m", "_n", "_key", *own, *(f"_{c}" for c in own))], *[F.coalesce(f"_{c}", c).alias(c) for c in own])


def classes(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Each document's class: (doc_id, node, class_id, n_class, kept, repeats), one row for each row of ``docs`` (doc_id, text).

    Equal texts are one node from the start, so copies of any number cost one comparison. Different texts are candidates
    if a band of their signatures agrees. The first FIRST bands' buckets are compared, what they connect becomes classes, and
    the other bands' buckets are compared where they hold several classes. A comparison is exact, of all pairs of a bucket
    whose classes differ; no bucket is capped, and what leaves a cell is a spanning set of its links. A class is a
    connected component of links between texts that overlap by ``least`` or more; its id is its smallest doc_id.

    Whole texts are compared, however long; a part of a bucket has bounded shingles. Other columns are left out, whatever their names.
    Null, empty and blank texts have no shingles, link with nothing and are classes of their own (node null). Null ids
    belong to their text's class and are never its id unless no other is there. ``repeats`` counts the rows that share
    doc_id and text; all of them are ``kept`` together where the class keeps that id. An empty table gives no rows.
    """
    signed = cut(sign(docs, bands=bands, rows=rows, words=words), "bag-signed")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.any_value("bands").alias("bands"), F.any_value("size").alias("size"))
    nodes = cut(nodes, "bag-nodes")
    held = cut(nodes.select("node", "size", F.posexplode("bands").alias("band", "key")), "bag-bands")
    several = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    every, held = held, cut(held.join(several, "key"), "bag-held")
    discard(every)
    bags = _bags(docs, nodes, held.select("node").distinct(), words)
    first = _buckets(held.where(F.col("band") < FIRST).withColumn("root", F.col("node")), block, shingles)
    links = cut(_links(first, bags, least), "bag-links")
    roots = components(links, "bag-cc").withColumnRenamed("node", "_node")
    rest = held.where(F.col("band") >= FIRST).join(roots, F.col("node") == F.col("_node"), "left").select("node", "key", "size", F.coalesce("root", "node").alias("root"))
    rest = cut(rest, "bag-rest")
    first, links = links, cut(links.union(_links(_buckets(rest, block, shingles), bags, least)), "bag-links")
    discard(first, rest, held, bags)
    roots = components(links, "bag-cc").withColumnRenamed("node", "_node")
    named = nodes.select("node", "doc_id", "n").join(roots, F.col("node") == F.col("_node"), "left").select("node", "doc_id", "n", F.coalesce("root", "node").alias("root"))
    top = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("n_class"), F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("best"))
    named = named.join(top.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root")).select(F.col("node").alias("_n"), "n", "class_id", "n_class", "best")
    rows_ = signed.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("repeats"))
    out = _with_class(rows_, cut(named, "bag-named"), nodes)
    kept = F.col("node").isNull() | ((F.col("node") == F.col("best")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    out = out.select("doc_id", "node", F.coalesce("class_id", F.when(F.col("node").isNull(), F.col("doc_id"))).alias("class_id"), F.coalesce("n_class", F.lit(1)).alias("n_class"), kept.alias("kept"), "repeats")
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).drop("_i")


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row of its smallest doc_id, all its columns, once.

    Rows that go are told by id and text; few of them are broadcast, many joined by shuffle. Of kept rows that share id
    and text one stays. Null, empty and blank texts all stay.
    """
    found = cut(classes(docs, least).where("node IS NOT NULL").select("doc_id", "node", "kept", "repeats").distinct(), "bag-kept")
    go = found.where("NOT kept OR repeats > 1").select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node"), F.col("kept").alias("_stay"))
    side = F.broadcast(go) if small_enough(go, BROADCAST_IDS) else go
    name = spare_name(docs, "_h")
    rows = docs.withColumn(name, F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = rows.join(side, (rows[name] == F.col("_node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")), "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return rows.where("_node IS NULL").select(*names).union(rows.where("_stay").dropDuplicates(["_doc", "_node"]).select(*names))


def op10_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_class", "kept")
