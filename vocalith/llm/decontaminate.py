"""Benchmark decontamination by winnowing: which words of which documents stand in windows of benchmark items.

Words are hashed in stretches of k; of every w stretches in a row the one of least hash (the last of equals) is kept as a fingerprint, with
w + k - 1 the length t of a window. A window that a document shares with an item has the same w stretches in both, so both keep the same one of
them: fingerprints that agree, joined by hash and extended word by word to at most a window's length, find every shared window. Items
shorter than a window are windows of their own length, for which documents are winnowed once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from vocalith.llm.common import cut, small_enough, spare_name, table, text_batches, tidy

WINDOW = 10
#: Bytes of texts that are hashed together; bits of the filter of item hashes, at least and at most, and for each fingerprint.
BLOCK, BITS, MOST_BITS, BITS_EACH = 1 << 20, 1 << 20, 1 << 28, 32
#: Fingerprints of items up to which they are broadcast; beyond, both sides meet by hash and part, in so many parts.
SENT, PARTS = 200_000, 32
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Lower case of A to Z; bytes that no word has become 0.
TO_WORD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)


def grams(t: int) -> tuple[int, int]:
    """(k, w) for windows of t words: words of a stretch, and stretches of which one is kept."""
    k = (t + 1) // 2
    return k, t - k + 1


def _mixed(z: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


#: Powers of the base and of its inverse modulo 2**64, as far as any block has needed them.
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS[i] = np.cumprod(row)
    return _POWERS


class Words:
    """The words of a block of texts: where they begin and end in its bytes, their hashes, and each text's words."""

    def __init__(self, texts: list[bytes]):
        self.data = TO_WORD[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
        inside = np.zeros(len(self.data) + 1, bool)
        inside[1:] = self.data != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.hash = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(self.start):  # as many words as a block's bytes hold, so that a very long text takes no more memory
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + BLOCK, "right")))
            low, high = int(self.start[a]), int(self.end[b - 1])
            power, inverse = _powers(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTES[self.data[low:high]] * power[: high - low], out=sums[1:])
            s, e = self.start[a:b] - low, self.end[a:b] - low
            self.hash[a:b] = _mixed((sums[e] - sums[s]) * inverse[s])
            a = b
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.last = np.searchsorted(self.start, ends)  # words before the end of each text
        self.first = np.concatenate([[0], self.last[:-1]])
        self.text = np.repeat(np.arange(len(texts)), self.last - self.first)

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def winnowed(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that begin a kept stretch, for windows of t words, and the stretches' hashes."""
        (k, w), n = grams(t), len(self.hash)
        if n < t:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.full(n - k + 1, t, np.uint64)
        for j in range(k):
            h = h * BASE + self.hash[j : n - k + 1 + j]
        h = _mixed(h)
        windows = n - t + 1
        least, at = h[:windows].copy(), np.zeros(windows, np.int64)
        for j in range(1, w):
            new = h[j : windows + j]
            at[new <= least] = j
            np.minimum(least, new, out=least)
        whole = self.text[:windows] == self.text[t - 1 :]
        kept = np.unique((np.arange(windows) + at)[whole])
        return kept, h[kept]

    def around(self, place: int, t: int) -> tuple[list[str], list[str]]:
        """Words before a place, the nearest first, and from it on, as far as windows over its stretch reach within the text."""
        text = self.text[place]
        low, high = max(int(self.first[text]), place - t + grams(t)[0]), min(int(self.last[text]), place + t)
        return [self.word(i) for i in range(place - 1, low - 1, -1)], [self.word(i) for i in range(place, high)]


def _blocks(texts: list[str | None]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        if block and size + len(b) > BLOCK:
            yield block
            block, size = [], 0
        block.append(b)
        size += len(b)
    if block:
        yield block


HIT = "struct<t:int,place:long,hash:long,left:array<string>,right:array<string>>"
_HIT = pa.struct([("t", pa.int32()), ("place", pa.int64()), ("hash", pa.int64()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])


def fingerprints(rows: DataFrame, lengths: list[int] | None, wanted=None) -> DataFrame:
    """(key, n_words, hits) for rows (key, text): the kept stretches of a text with the words around them.

    For documents ``lengths`` are the windows' lengths; without it the row is an item, winnowed for its own window. ``wanted`` is a broadcast
    array of bits; stretches whose hash has no bit there are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value if wanted else None
        for b in batches:
            counts, hits = [], []
            for block in _blocks(b.column(1).to_pylist()):
                words = Words(block)
                n = words.last - words.first
                counts.append(n)
                found: list[list] = [[] for _ in block]
                for t in lengths if lengths is not None else sorted({min(WINDOW, int(x)) for x in n} - {0}):
                    at, h = words.winnowed(t)
                    if lengths is None:
                        some = np.minimum(n[words.text[at]], WINDOW) == t
                    else:
                        bit = h & np.uint64(len(bits) * 8 - 1)
                        some = bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1
                    for place, code in zip(at[some].tolist(), h[some].view(np.int64).tolist()):
                        text = int(words.text[place])
                        left, right = words.around(place, t)
                        found[text].append({"t": t, "place": place - int(words.first[text]), "hash": code, "left": left, "right": right})
                hits += found
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(hits, pa.list_(_HIT))], ["key", "n_words", "hits"])

    return rows.mapInArrow(lambda batches: tidy(run(batches)), rows.select("key").schema.add("n_words", "long").add("hits", DataType.fromDDL(f"array<{HIT}>")))


def _filter_bits(hashes: DataFrame, count: int) -> np.ndarray:
    """Bits of the hashes' low parts, of bounded size; made as bitmaps in tasks."""
    size = min(MOST_BITS, max(BITS, 1 << (count * BITS_EACH - 1).bit_length())) if count else BITS
    place = (F.col("hash").bitwiseAND(F.lit(size - 1)) + 1).alias("p")
    maps = hashes.select(place).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros(size // 8, np.uint8)
    for b, m in maps:
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(m), np.uint8)
    return out


def _alike(a: str, b: str) -> Column:
    """In how many items from the first on two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(same))


def _covered(spans: Column) -> Column:
    """How many places the spans (a, b), b excluded, cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda s: s["n"])


def shared_windows(docs: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``docs`` without ``text``; ``n_words`` long, ``spans`` array<struct<a, b: long>> (words from a up to b, b excluded, that stand in windows of items;
    they may overlap) and ``items`` array (different ids of these items).

    Null, empty and blank texts have no words, no spans and no items; as items they match nothing. Of stretches that tie the last one is kept. Repeated
    documents each have their row; repeated items count once by id, and an item without an id marks words but isn't listed. Without documents there are no
    rows, without items no spans. Other columns stay under any name; a new column gives way to one of its name by underscores in front.
    A document's spans and items meet in one task, bounded by its own words and the items found.
    """
    spark = docs.sparkSession
    text_batches(spark)
    kept = [c for c in docs.columns if c.lower() != text.lower()]
    names = [spare_name(docs.drop(text), c) for c in ("n_words", "spans", "items")]
    tests = items.select(F.col(f"`{item}`").alias("key"), F.col(f"`{text}`").alias("text"))
    prints = cut(fingerprints(tests, None).select("key", F.explode("hits").alias("h")).select(F.col("key").alias("item"), "h.t", "h.hash", F.col("h.left").alias("item_left"), F.col("h.right").alias("item_right")).distinct(), "window-items")
    by_length = {r["t"]: r["n"] for r in prints.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    count = sum(by_length.values())
    bits = spark.sparkContext.broadcast(_filter_bits(prints, count))
    # numbers of rows hold once they are written
    key = F.struct(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    base = cut(fingerprints(docs.select(key.alias("key"), F.col(f"`{text}`").alias("text")), sorted(by_length), bits), "window-docs")
    found = base.where(F.size("hits") > 0).select(F.col("key.row").alias("row"), F.explode("hits").alias("h")).select("row", "h.*")
    if small_enough(prints, SENT):
        met = found.join(F.broadcast(prints), ["t", "hash"])
    else:  # hot hashes are dealt over parts, which the items' side repeats
        parted = prints.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        met = found.withColumn("part", F.pmod(F.xxhash64("row", "place"), F.lit(PARTS)).cast("int")).join(parted, ["t", "hash", "part"])
    met = met.select("row", "place", "t", "item", _alike("left", "item_left").alias("before"), _alike("right", "item_right").alias("after")).where("before + after >= t")
    span = F.struct((F.col("place") - F.col("before")).alias("a"), (F.col("place") + F.col("after")).alias("b"))
    told = met.groupBy("row").agg(F.collect_set(span).alias("spans"), F.collect_set("item").alias("items"))
    rows = base.select("key", "n_words", F.col("key.row").alias("row")).join(told, "row", "left")
    listed = [F.coalesce(F.col(c), F.array().cast(told.schema[c].dataType)) for c in ("spans", "items")]
    return rows.select(*[F.col(f"key.c{i}").alias(c) for i, c in enumerate(kept)], *[value.alias(name) for value, name in zip([F.col("n_words"), *listed], names)])


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shared_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    hit = _covered(F.col("spans"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


WINDOWS_SQL = r"""WITH a AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS t, array_to_string(w[j : j + least(len(w), 10) - 1], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS j FROM b WHERE len(w) > 0)),
d AS (SELECT r, t, j, array_to_string(w[j : j + t - 1], ' ') AS x FROM (SELECT r, w, t, unnest(range(1, len(w) - t + 2)) AS j FROM a, (SELECT DISTINCT t FROM i) WHERE len(w) >= t)),
m AS (SELECT r, d.t, j, item_id FROM d JOIN i ON d.t = i.t AND d.x = i.x),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(j, j + t)) AS p FROM m) GROUP BY r),
s AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS x FROM m GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(s.n, 0) AS n_items, sha256(coalesce(s.x, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated FROM a LEFT JOIN h ON a.r = h.r LEFT JOIN s ON a.r = s.r"""
