"""The standardiser's equivalence rules as column expressions: what happens before and after the base standardiser stays in the JVM.

Rules that look at neighbours work on whole runs, which one pattern cuts out of a text in order, or on a token's neighbours in its array; so each is linear
in the text. ``with_normalised`` puts them around the base standardiser, which alone is a UDF; ``functions.text.normalise`` has the same rules in Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalith.functions.columns import bound
from vocalith.functions.text import MONTHS, ONES, RULES, UNITS, standardise

_MONTH = "|".join(MONTHS)
#: Regions that write the month first.
MONTH_FIRST = ("US", "PH", "FM", "MH", "PW")
#: Digits from which a run of groups is one number, single digits from which a run is, months that are words as well.
RUN_DIGITS, SINGLE_DIGITS, WORD_MONTHS = 7, 3, ("march", "may")
_SURE = "|".join(m for m in MONTHS if m not in WORD_MONTHS)


def _sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, pattern, to)


def numeric_dates(text: Column, order: Column) -> Column:
    """4/20/1980 as month, day and year in words; what is no date stays."""
    day = "0?([1-9]|[12][0-9]|3[01])"

    def by(month_first: bool) -> Column:
        forms = ((rf"\b0?{m}([/-]){day}\1([0-9]{{4}})\b", f"{name} $2 $3") if month_first else (rf"\b{day}([/-])0?{m}\2([0-9]{{4}})\b", f"{name} $1 $3") for m, name in enumerate(MONTHS, 1))
        return reduce(lambda t, f: _sub(t, *f), forms, text)

    return F.when(order == "dmy", by(False)).otherwise(by(True))


def leading_zeros(text: Column) -> Column:
    """Whole numbers that begin with 0, digit by digit in words."""
    marked = _sub(text, r"(?:(?<![0-9.])(?=0[0-9]+(?![0-9.]))|\G(?<=[0-9]))([0-9])", "\x01$1")
    spaced = _sub(marked, r"(\x01[0-9])(?=\x01)", "$1 ")
    return reduce(lambda t, d: F.replace(t, F.lit(f"\x01{d}"), F.lit(ONES[d])), range(10), spaced)


def digit_one(tokens: Column) -> Column:
    """``one`` beside a group of digits is 1; neighbours are those of the text as it came."""
    return bound(_digit_one, tokens)


def _digit_one(tokens: Column) -> Column:
    digits = lambda t: F.coalesce(t.rlike(r"^\p{Nd}+$"), F.lit(False))
    return F.transform(tokens, lambda t, i: F.when((t == "one") & (digits(F.get(tokens, i - 1)) | digits(F.get(tokens, i + 1))), "1").otherwise(t))


def digit_join(text: Column) -> Column:
    """Runs of groups of digits as one number, where they are long enough to be one."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{Nd}+(?: \p{Nd}+)*(?!\S)|\S+"), F.lit(0))

    def joined(run: Column) -> Column:
        whole = F.replace(run, F.lit(" "), F.lit(""))
        groups = F.length(run) - F.length(whole) + 1
        single = F.length(whole) == groups
        return F.when((groups > 1) & ((F.length(whole) >= RUN_DIGITS) | single & (groups >= SINGLE_DIGITS)), whole).otherwise(run)

    return F.array_join(F.transform(runs, joined), " ")


def spoken_dates(text: Column) -> Column:
    """Day and month in the order month, day: after ``of``, or without it where the month can't be a word or a year follows."""
    turned = _sub(text, rf"(?<!\S)(one|[1-9]|[12][0-9]|3[01]) (?:of ({_MONTH})|({_SURE})|({'|'.join(WORD_MONTHS)})(?= [0-9]{{4}}(?!\S)))(?!\S)", "$2$3$4 $1")
    return _sub(turned, rf"(?<!\S)({_MONTH}) one(?!\S)", "$1 1")


def _raw_steps(order: Column) -> tuple:
    return (
        ("okay", lambda t: _sub(t, r"(?i)\bo\.\s?k\.?(?![a-z])", "okay")), ("ninth", lambda t: _sub(t, r"(?i)\bninth\b", "nineth")), ("numeric_dates", lambda t: numeric_dates(t, order)),
        ("paren_digits", lambda t: _sub(t, r"\(([0-9][0-9\s.-]*)\)", " $1 ")), ("leading_zero", leading_zeros),
    )


def _word_steps() -> tuple:
    units = F.map_from_arrays(F.array(*map(F.lit, UNITS)), F.array(*map(F.lit, UNITS.values())))
    return (
        ("units", lambda t: F.array_join(F.transform(F.split(t, " "), lambda w: F.coalesce(F.try_element_at(units, w), w)), " ")), ("okay", lambda t: _sub(t, r"(?<!\S)ok(?!\S)", "okay")),
        ("ordinals", lambda t: _sub(t, r"(?<!\S)(\p{Nd}+)(?:st|nd|rd|th)(?!\S)", "$1")), ("decimals", lambda t: _sub(_sub(t, r"(?<!\S)one(?=\.\p{Nd}+(?!\S))", "1"), r"(?<!\S)(?=\.\p{Nd}+(?!\S))", "0")),
        ("digit_one", lambda t: F.array_join(digit_one(F.split(t, " ")), " ")), ("digit_join", digit_join), ("spoken_dates", spoken_dates),
    )


def _untagged(text: Column) -> Column:
    return _sub(text, r"</?[A-Za-z][A-Za-z0-9_-]*\s*/?>", " ")


def _through(steps: Iterable[tuple], text: Column, on: set[str]) -> Column:
    return reduce(lambda t, s: s[1](t) if s[0] in on else t, steps, text)


def before(text: Column, order: Column, on: set[str]) -> Column:
    """Tags and what the raw text's rules rewrite."""
    return _through(_raw_steps(order), _untagged(text), on)


def after(text: Column, on: set[str]) -> Column:
    """What the standardised words' rules rewrite; words are apart by single blanks."""
    return _through(_word_steps(), text, on)


def _without_each(df: DataFrame, text: Column, at: str, steps: Sequence[tuple], offs: Iterable[Iterable[str]]) -> tuple[DataFrame, list[Column]]:
    """``df`` with ``text`` after each step in columns ``at``0, 1, ..., and the text without each of ``offs``: that of all steps, unless one left out
    changes its text, from which on the others are then done again."""
    df = df.withColumn(f"{at}0", text)
    for i, (_, step) in enumerate(steps):
        df = df.withColumn(f"{at}{i + 1}", step(F.col(f"{at}{i}")))

    def without(off: Iterable[str]) -> Column:
        whole, left = F.col(f"{at}{len(steps)}"), [i for i, (name, _) in enumerate(steps) if name in off]
        if not left:
            return whole
        changed = reduce(or_, [F.col(f"{at}{i}") != F.col(f"{at}{i + 1}") for i in left])
        return F.when(changed, _through(steps[left[0] :], F.col(f"{at}{left[0]}"), {name for name, _ in steps} - set(off))).otherwise(whole)

    return df, [without(off) for off in offs]


def standardised(texts: Column) -> Column:
    """The base standardiser of a row's texts, of which it does different ones once; null stays null. Nothing that is computed of it is computed in its place."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        rows = [{t: None if t is None else standardise(t) for t in dict.fromkeys(x)} for x in s]
        return pd.Series([[done[t] for t in x] for x, done in zip(s, rows)], dtype=object)

    return run.asNondeterministic()(texts)


def rules_on(disable: Iterable[str] = ()) -> set[str]:
    if odd := set(disable) - set(RULES):
        raise ValueError(f"unknown rules: {sorted(odd)}")
    return set(RULES) - set(disable)


def with_normalised(df: DataFrame, text: Column | str, into: str, date_order: Column | str = "mdy", disable: Iterable[Iterable[str]] | None = None) -> DataFrame:
    """``df`` with its ``text`` normalised in a column: as ``functions.text.normalised`` does, with all rules in the JVM.

    With ``disable``, a list of lists of rules, the column is an array with a text for each list; the base standardiser runs once for each
    different text before it, whatever the rules after it, and of the rules only those again that follow a rule left out which changes the text.
    """
    variants = [rules_on(x) for x in (disable if disable is not None else [()])]
    text = F.col(text) if isinstance(text, str) else text
    order = F.lit(date_order) if isinstance(date_order, str) else date_order
    if disable is None:
        return df.withColumn("_s", standardised(F.array(before(text, order, variants[0])))).withColumn(into, after(F.col("_s")[0], variants[0])).drop("_s")
    raw, offs = _raw_steps(order), [set(RULES) - on for on in variants]
    kind = lambda off: tuple(sorted(off & {name for name, _ in raw}))
    kinds = sorted({(), *map(kind, offs)})  # that of all rules is the first
    rows, texts = _without_each(df, _untagged(text), "_raw", raw, kinds)
    rows, made = _without_each(rows.withColumn("_s", standardised(F.array(*texts))), F.col("_s")[0], "_words", _word_steps(), offs)
    base = [F.col("_s")[kinds.index(kind(off))] for off in offs]
    made = [F.when(b != F.col("_s")[0], after(b, on)).otherwise(m) if kind(off) else m for b, m, off, on in zip(base, made, offs, variants)]
    return rows.withColumn(into, F.array(*made)).select(*[c for c in df.columns if c != into], into)


def date_order(language: Column) -> Column:
    """Month first for tags that are null, bare, or of a region that writes so; else day first."""
    region = F.get(F.filter(F.split(F.upper(language), "-"), lambda x, i: (i > 0) & (F.length(x) == 2)), F.lit(0))
    return F.when(F.coalesce(region.isin(*MONTH_FIRST), F.lit(True)), "mdy").otherwise("dmy")


def normalised_run(rows: DataFrame, manifest: DataFrame, configs: DataFrame) -> DataFrame:
    """(utt_id, config_id, ref, hyp) of a run's ``rows`` (utt_id, config_id, hyp_text): references in the date order of their language, hypotheses in
    the one that their config writes (``output_date_order`` of ``configs``), or the reference's where it is null or the config unknown.

    A failed row's null text is empty. Configs are a registry's; each comes once.
    """
    order = date_order(F.col("language"))
    told = rows.join(manifest.select("utt_id", "ref_text", order.alias("_order")), "utt_id").join(configs.select("config_id", "output_date_order"), "config_id", "left")
    told = with_normalised(told.withColumn("hyp_text", F.coalesce("hyp_text", F.lit(""))), "ref_text", "ref", F.col("_order"))
    return with_normalised(told, "hyp_text", "hyp", F.coalesce("output_date_order", "_order")).select("utt_id", "config_id", "ref", "hyp")
