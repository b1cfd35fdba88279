"""Periodic run detection: all maximal stretches of words that repeat with a period, and texts without the repetitions.

A run with smallest period q has at least ``max(LEAST, POWER * q)`` words. The words x and x + q are equal over a stretch of at least
``max(LEAST - q, (POWER - 1) * q)`` places x, so places that far apart (a grid for each period, harmonic in their number) meet every run.
All pairs of a period and a grid place extend at once to both sides, by binary search over prefix hashes in NumPy; the words of
what remains are compared in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from vocalith.llm.common import spare_name, table, text_batches, tidy

#: Words of the shortest run, and periods that a run holds at least.
LEAST, POWER = 24, 3
#: Pairs of a period and a place that are looked at together, which bounds memory beyond a few numbers a word.
PAIRS = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD = r"[^\x20\x09-\x0D]+"


def word_codes(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and their numbers, equal for equal words. ``bytes.split`` cuts at just \\x20 and \\x09 to \\x0D."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    return words, np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _pairs(n: int, least: int, power: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (period, place) that together meet every run of n words, smaller periods first."""
    periods = np.arange(1, n // power + 1)
    step = np.maximum(least - periods, (power - 1) * periods)
    # a stretch of ``step`` places that ends before n - period holds a multiple of ``step``
    count = np.where(n - periods >= step, (n - periods - 1) // step + 1, 0)
    ends = np.cumsum(count)
    a = 0
    while a < len(periods):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        c = count[a:b]
        p = np.repeat(periods[a:b], c)
        x = (np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)) * np.repeat(step[a:b], c)
        yield p, x
        a = b


class _Prefixes:
    """Prefix hashes of a text's words, modulo 2**64; any two stretches compare in constant time."""

    def __init__(self, codes: np.ndarray):
        z = codes.astype(np.uint64) + np.uint64(1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        self.power = np.full(len(codes) + 1, BASE)
        self.power[0] = 1
        self.power = np.cumprod(self.power)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((z ^ (z >> np.uint64(31))) * self.power[:-1], out=self.sums[1:])

    def equal(self, x: np.ndarray, p: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` words from x are those from x + p."""
        s = self.sums
        return (s[x + length] - s[x]) * self.power[p] == s[x + p + length] - s[x + p]

    def extend(self, x: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The longest equal stretches from x and x + p on (or up to them, going back), at most ``most``: all by one binary search."""
        low, high = np.zeros_like(x), most.copy()
        while True:
            at = np.flatnonzero(low < high)
            if not len(at):
                return low
            mid = (low[at] + high[at] + 1) >> 1
            same = self.equal(x[at] - mid if back else x[at], p[at], mid)
            low[at[same]] = mid[same]
            high[at[~same]] = mid[~same] - 1


def _plain_runs(codes: np.ndarray, least: int, power: int) -> dict[tuple[int, int], int]:
    """Runs by comparing all words for every period: for texts on which hashes collide."""
    found: dict[tuple[int, int], int] = {}
    for p in range(1, len(codes) // power + 1):
        same = np.concatenate([[False], codes[:-p] == codes[p:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + p >= max(least, power * p):
                found.setdefault((a, b + p), p)
    return found


def find_runs(codes: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period. ``power`` is at least 2."""
    n, found = len(codes), {}
    if n < least:
        return []
    prefixes: _Prefixes | None = None
    for p, x in _pairs(n, least, power):
        some = codes[x] == codes[x + p]
        p, x = p[some], x[some]
        if not len(p):
            continue
        prefixes = prefixes or _Prefixes(codes)
        ahead = prefixes.extend(x, p, n - p - x, False)
        behind = prefixes.extend(x, p, x, True)
        start, end = x - behind, x + ahead + p
        long = end - start >= np.maximum(least, power * p)
        for s, e, q in zip(start[long].tolist(), end[long].tolist(), p[long].tolist()):
            # a stretch's smallest period comes first and divides its other ones, unless hashes collided
            if q % found.setdefault((s, e), q):
                return sorted((s, e - s, q) for (s, e), q in _plain_runs(codes, least, power).items())
    for (s, e), q in found.items():
        if not np.array_equal(codes[s : e - q], codes[s + q : e]):
            found = _plain_runs(codes, least, power)
            break
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        change[s + q] += 1
        change[s + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0))


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """``docs`` without ``text``, and ``n_words`` long, ``runs`` array<struct<start, length, period: long>> and ``collapsed`` string.

    Runs are ordered by start and period; ``collapsed`` is the text without repetitions, its words joined by one blank. Null, empty and blank
    texts have no words, no runs and an empty ``collapsed``. Rows stand alone: repeated rows agree, there are no ties between
    rows, an empty table gives none, and a lost task is just run again. Other columns stay as they are; a new column gives way to a
    column of its name by underscores in front. Whole texts are searched, in memory in proportion to their words.
    """
    text_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != text.lower()]
    own = docs.select(*[F.col(f"`{c}`") for c in kept])
    names = [spare_name(own, c) for c in ("n_words", "runs", "collapsed")]
    schema = own.schema
    for name, kind in zip(names, ("long", "array<struct<start:long,length:long,period:long>>", "string")):
        schema = schema.add(name, DataType.fromDDL(kind))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, runs, rest = [], [], []
            for t in b.column(0):
                words, codes = word_codes(t.as_py())
                found = find_runs(codes, least, power)
                count.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                rest.append(collapse(words, found))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(count, pa.int64()), pa.array(runs, spans), pa.array(rest, pa.binary()).cast(pa.string())], [*kept, *names])

    return docs.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(lambda batches: tidy(run(batches)), schema)


def repeat_words(words: Column, start: Column, period: Column) -> Column:
    """The text in which, from word ``start`` on, the ``period`` words there repeat to the end."""
    return F.array_join(F.transform(words, lambda w, i: F.when(i < start, w).otherwise(F.get(words, (start + (i - start) % period).cast("int")))), " ")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumn("g", F.floor(h / 10)).withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n = F.size("w").cast("long")
    docs = docs.withColumn("a", F.when(n > 0, F.col("g") % n))
    docs = docs.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    docs = docs.select("doc_id", F.when(F.col("a").isNotNull(), repeat_words(F.col("w"), F.col("a"), F.col("p"))).otherwise(F.col("text")).alias("text"))
    found = periodic_runs(docs)
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])  # noqa: E731  runs come by start and period, so the first of equals stays
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
