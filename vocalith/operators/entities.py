"""Entities in normalised references, and how hypotheses keep them.

Tagging runs in one Arrow UDF, as spans need token positions: patterns category by category, the terms of all lexicons in one walk over a
trie of tokens, whose time doesn't follow the number of terms. Scoring and summaries are column expressions over ``alignment``'s chunks.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions.columns import bound
from vocalith.functions.text import MONTHS, normalise, normalised
from vocalith.operators.alignment import paired_words, token_hits

SPAN = "struct<category:string,start:int,end:int,text:string>"
Z95 = 1.959963984540054

# What each built-in category looks like in normalised text, what separates spoken or written digits, where thousands are cut.
SEPARATORS, THOUSANDS = r"(?<=\d)[\s().-]+(?=\d)", r"(?<=\d),(?=\d{3})"
_MONTH = f"(?:{'|'.join(MONTHS)})"
_AMOUNT = r"(?:\d+(?:\.\d+)?|one)"
BUILTINS = {
    "number": r"[$£€]?\d[\d.,]*%?",
    "phone": r"\d{7,15}",
    "date": rf"{_MONTH} \d{{1,2}} \d{{4}}|\d{{1,2}} (?:of )?{_MONTH} \d{{4}}|\d{{1,2}} (?:of )?{_MONTH}|{_MONTH} \d{{1,2}}|{_MONTH} \d{{4}}",
    "dosage": rf"{_AMOUNT} (?:mg|mcg|ml|g|iu|units?|puffs?|tablets?|capsules?|drops?|sachets?|sprays?)",
    "duration": rf"{_AMOUNT} (?:seconds?|minutes?|hours?|days?|weeks?|months?|years?)",
}


#: What every built-in category holds somewhere.
_NUMBER = re.compile(r"\d|one")


@dataclass(frozen=True)
class Category:
    """Exactly one of ``builtin``, ``terms`` and ``pattern`` says what the category holds."""

    name: str
    builtin: str | None = None
    terms: Sequence[str] = ()
    pattern: str | None = None

    def __post_init__(self) -> None:
        if (self.builtin is not None) + bool(self.terms) + (self.pattern is not None) != 1:
            raise ValueError(f"{self.name}: give one of builtin, terms, pattern")
        if self.builtin is not None and self.builtin not in BUILTINS:
            raise ValueError(f"{self.name}: unknown builtin {self.builtin}")

    def regex(self, date_order: str) -> re.Pattern:
        if self.pattern is not None:
            return re.compile(self.pattern)
        if self.builtin:
            return re.compile(rf"(?<!\S)(?:{BUILTINS[self.builtin]})(?!\S)")
        terms = {normalise(t, date_order) for t in self.terms} - {""}
        longest = sorted(terms, key=lambda t: (-t.count(" "), t))
        return re.compile(rf"(?<!\S)(?:{'|'.join(map(re.escape, longest))})(?!\S)" if terms else r"(?!)")


class Trie:
    """Terms of several lexicons, token by token: a node maps the next token to a node, and None to the lexicons whose term ends there."""

    def __init__(self, terms: Iterable[tuple[str, int]]):
        self.root: dict = {}
        for term, lexicon in terms:
            node = self.root
            for token in term.split():
                node = node.setdefault(token, {})
            if node is not self.root:
                node.setdefault(None, set()).add(lexicon)

    def spans(self, tokens: Sequence[str]) -> list[tuple[int, int, int]]:
        """(lexicon, start, end): for each lexicon the leftmost longest terms that don't overlap. A place is walked from as far as any term goes on."""
        out, free = [], {}
        for i in [i for i, token in enumerate(tokens) if token in self.root]:
            node, end, longest = self.root[tokens[i]], i + 1, {}
            while node is not None:
                for lexicon in node.get(None, ()):
                    longest[lexicon] = end
                node, end = node.get(tokens[end]) if end < len(tokens) else None, end + 1
            for lexicon, end in longest.items():
                if free.get(lexicon, 0) <= i:
                    out.append((lexicon, i, end))
                    free[lexicon] = end
        return out


def tag(text: str, found: Sequence[tuple[Category, re.Pattern]], lexicons: Sequence[str] = (), trie: Trie | None = None) -> list[tuple[str, int, int, str]]:
    """(category, start, end, text), ordered; generic numbers yield to all that overlap them. ``trie`` has terms of the categories ``lexicons``."""
    tokens = text.split()
    text, starts, at = " ".join(tokens), [], 0
    for t in tokens:
        starts.append(at)
        at += len(t) + 1
    generic, specific = [], [(lexicons[c], a, z, " ".join(tokens[a:z])) for c, a, z in (trie.spans(tokens) if trie else ())]
    numbered = _NUMBER.search(text) is not None
    for category, pattern in found:
        if category.builtin and not numbered:
            continue
        for m in pattern.finditer(text):
            if m.end() > m.start():
                a, z = bisect_right(starts, m.start()) - 1, bisect_left(starts, m.end())
                (generic if category.builtin == "number" else specific).append((category.name, a, z, " ".join(tokens[a:z])))
    taken = {i for _, a, z, _ in specific for i in range(a, z)}
    return sorted(specific + [s for s in generic if taken.isdisjoint(range(s[1], s[2]))], key=lambda s: (s[1], s[2], s[0]))


#: Terms from which a lexicon is normalised on the executors.
MANY = 2000


def normal_terms(spark: SparkSession, terms: Sequence[str], date_order: str = "mdy") -> list[str]:
    """A lexicon's different terms as they stand in normalised text."""
    if len(terms) < MANY:
        return sorted({normalise(t, date_order) for t in terms} - {""})
    rows = spark.createDataFrame([(t,) for t in terms], "t STRING").repartition(spark.sparkContext.defaultParallelism)
    return sorted({r[0] for r in rows.select(normalised(F.col("t"), date_order)).distinct().collect()} - {""})  # as many as the caller gave


def tagged(text: Column, categories: Sequence[Category], date_order: str = "mdy") -> Column:
    """Spans of a column of normalised texts; null has none.

    Terms of lexicons go to executors once, as a broadcast of the size of the caller's own list; each Python worker keeps one trie of them.
    """
    names = [c.name for c in categories]
    if len(set(names)) < len(names):
        raise ValueError("categories need different names")
    spark = SparkSession.active()
    lexicons = [c for c in categories if c.terms]
    terms = [(t, i) for i, c in enumerate(lexicons) for t in normal_terms(spark, list(c.terms), date_order)]
    sent = spark.sparkContext.broadcast(terms) if terms else None
    others, own = [c for c in categories if not c.terms], uuid.uuid4().hex

    @F.pandas_udf(f"array<{SPAN}>")
    def run(s: pd.Series) -> pd.Series:
        trie = _kept(own, sent) if sent else None
        found = [(c, c.regex(date_order)) for c in others]
        lexicon_names = [c.name for c in lexicons]
        return pd.Series([[dict(zip(("category", "start", "end", "text"), x)) for x in tag(t or "", found, lexicon_names, trie)] for t in s], dtype=object)

    return run(text)


_TRIES: dict[str, Trie] = {}


def _kept(key: str, sent) -> Trie:
    """The worker's trie of a broadcast, of which it keeps the last one."""
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = Trie(sent.value)
    return _TRIES[key]


def canonical(number: Column) -> Column:
    """Without leading zeros of the whole part, of which one stays."""
    return F.regexp_replace(number, r"^0+(?=\d)", "")


def raw_numbers(raw: Column) -> Column:
    """(runs, numbers) of a raw hypothesis: its different runs of digits with separators taken out, and its different numbers."""
    plain = F.regexp_replace(raw, THOUSANDS, "")
    runs = F.regexp_extract_all(F.regexp_replace(plain, SEPARATORS, ""), F.lit(r"\d+"), 0)
    return F.struct(F.array_distinct(runs).alias("runs"), F.array_distinct(_numbers(plain)).alias("numbers"))


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), 0), canonical)


def holds(span: Column, builtin: Column, found: Column) -> Column:
    """Whether the numbers ``found`` of a raw hypothesis have the span's."""
    wanted = _numbers(F.regexp_replace(span, r"(?<!\S)one(?!\S)", "1"))
    return F.when(builtin == "phone", F.exists(found.runs, lambda r: F.contains(r, span))).otherwise((F.size(wanted) > 0) & (F.size(F.array_except(wanted, found.numbers)) == 0))


def is_formatted(span: Column, builtin: Column, raw: Column) -> Column:
    """Whether the raw hypothesis has the span's numbers as digits."""
    return holds(span, builtin, raw_numbers(raw))


def outcomes(df: DataFrame, categories: Sequence[Category], keys: Sequence[str]) -> DataFrame:
    """One row a span of ``ref`` (words): recovered, character errors, formatted (null where not numeric or no ``raw_hyp``).

    ``df`` has ``keys``, ``ref``, ``hyp``, ``raw_hyp`` and ``chunks``. What spans are compared with is made once a text, by words and as different numbers;
    a span's row has only its own part of it.
    """
    builtin = F.create_map(*[F.lit(x) for c in categories for x in (c.name, c.builtin or "")])
    texts = df.select(
        *keys, token_hits(F.col("chunks"), "ref").alias("_hits"), bound(paired_words, F.col("chunks"), F.col("hyp"), F.size("ref")).alias("_words"),
        raw_numbers(F.col("raw_hyp")).alias("_raw"), F.col("raw_hyp").isNotNull().alias("_told"), tagged(F.array_join("ref", " "), categories).alias("_spans"),
    )

    def own(s: Column) -> Column:
        words, kind = F.slice("_words", s.start + 1, s.end - s.start), builtin[s.category]
        got = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w.word).otherwise(F.concat(w.before, w.word))), "")
        return F.struct(
            s.category.alias("category"), s.start.alias("start"), s.end.alias("end"), s.text.alias("text"),
            F.forall(F.slice("_hits", s.start + 1, s.end - s.start), lambda x: x).alias("recovered"), got.alias("got"),
            F.when((kind != "") & F.col("_told"), holds(s.text, kind, F.col("_raw"))).alias("as_digits"),
        )

    flat = F.regexp_replace("text", " ", "")
    return texts.select(*keys, F.inline(F.transform("_spans", own))).select(
        *keys, "category", "start", "end", "text", "recovered", F.levenshtein(flat, F.col("got")).cast("bigint").alias("char_errors"), F.length(flat).cast("bigint").alias("char_total"),
        F.when(F.col("as_digits").isNotNull(), F.col("recovered") & F.col("as_digits")).alias("formatted"),
    )


def wilson(k: Column, n: Column, upper: bool) -> Column:
    z2 = Z95 * Z95
    half = Z95 / (n + z2) * F.sqrt(k * (n - k) / n + z2 / 4)
    mid = (k + z2 / 2) / (n + z2)
    return F.least(F.lit(1.0), mid + half) if upper else F.greatest(F.lit(0.0), mid - half)


def summary(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Recall and formatted share with their intervals, and the pooled character error rate, by category."""
    k, n = F.count_if("recovered"), F.count("*")
    fk, fn = F.count_if("formatted"), F.count("formatted")
    return found.groupBy(*keys, "category").agg(
        n.alias("n"), k.alias("recovered"), (k / n).alias("recall"), wilson(k, n, False).alias("recall_low"), wilson(k, n, True).alias("recall_high"),
        F.sum("char_errors").alias("char_errors"), F.sum("char_total").alias("char_total"), F.try_divide(F.sum("char_errors"), F.sum("char_total")).alias("cer"),
        F.when(fn > 0, fk).alias("formatted"), F.when(fn > 0, F.try_divide(fk, fn)).alias("formatted_share"),
        F.when(fn > 0, wilson(fk, fn, False)).alias("formatted_low"), F.when(fn > 0, wilson(fk, fn, True)).alias("formatted_high"),
    )
