"""Word alignment of a reference and a hypothesis: counts, chunks, hits and a readable difference.

Errors alone need no way back: ``distance`` counts them, for whole batches ``distances``. Alignments are bit-parallel: a column of the
edit distance table is a few whole numbers with a bit for each reference word, of which two are kept for the way back. Pairs whose table
would pass ``CELLS`` are split at the middle of the reference, which keeps the distance least and memory linear in the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import ne

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vocalith.functions.arrow import arrow
from vocalith.functions.columns import bound

#: Bits of a table that are kept for the way back: two for each cell.
CELLS = 64_000_000
CHUNK = "struct<op:string,ref_start:int,ref_end:int,hyp_start:int,hyp_end:int>"
SCORE = f"struct<substitutions:int,deletions:int,insertions:int,hits:int,chunks:array<{CHUNK}>>"


NAMES = {"e": "equal", "s": "substitute", "d": "delete", "i": "insert"}


def _places(words: Sequence[str]) -> dict[str, int]:
    """For each word a number whose bits are the places where it stands."""
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _columns(places: dict[str, int], size: int, hyp: Sequence[str]) -> Iterator[tuple[int, int, int, int]]:
    """For each hypothesis word, bits over the reference's words: where a diagonal step costs nothing, where a step down costs one, and
    where a step to the right costs one or gains one."""
    full = (1 << size) - 1
    down, up = full, 0
    for w in hyp:
        equal = places.get(w, 0) | up
        free = ((((equal & down) + down) ^ down) | equal) & full
        right, left = (up | ~(free | down)) & full, down & free
        shifted = right << 1 | 1
        down, up = (left << 1 | ~(free | shifted)) & full, shifted & free & full
        yield free, down, right, left


def _last_row(ref: Sequence[str], hyp: Sequence[str]) -> list[int]:
    """Distances of the whole reference to each beginning of the hypothesis."""
    out, top = [len(ref)], len(ref) - 1
    for _, _, right, left in _columns(_places(ref), len(ref), hyp):
        out.append(out[-1] + (right >> top & 1) - (left >> top & 1))
    return out


def distance(ref: Sequence, hyp: Sequence) -> int:
    """The least number of words to change; what both sides begin and end with costs nothing."""
    begin, end, most = 0, 0, min(len(ref), len(hyp))
    while begin < most and ref[begin] == hyp[begin]:
        begin += 1
    while end < most - begin and ref[-1 - end] == hyp[-1 - end]:
        end += 1
    ref, hyp = ref[begin : len(ref) - end], hyp[begin : len(hyp) - end]
    if not ref or not hyp:
        return len(ref) + len(hyp)
    return _last_row(ref, hyp)[-1] if len(ref) >= len(hyp) else _last_row(hyp, ref)[-1]


def _lists(a: pa.Array) -> Iterator[tuple[int, int] | None]:
    """Where each list's values begin and end among those of ``flatten``."""
    at = 0
    for n in a.value_lengths().to_pylist():
        yield None if n is None else (at, at + n)
        at += n or 0


def distances(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """``distance`` of every pair of word lists, null where one is null; words are compared as their numbers in the batch."""
    words = pa.concat_arrays([ref.flatten(), hyp.flatten()]).dictionary_encode(null_encoding="encode").indices.to_numpy().tolist()
    shift = len(ref.flatten())
    pairs = zip(_lists(ref), _lists(hyp))
    return pa.array([None if r is None or h is None else distance(words[r[0] : r[1]], words[shift + h[0] : shift + h[1]]) for r, h in pairs], pa.int64())


def _ops(ref: Sequence[str], hyp: Sequence[str]) -> str:
    """One letter a step, e(qual) s(ubstitute) d(elete) i(nsert); from the end, diagonal steps first, then deletions."""
    if len(ref) * len(hyp) > CELLS and len(ref) > 1:
        half = len(ref) // 2
        down, up = _last_row(ref[:half], hyp), _last_row(ref[half:][::-1], hyp[::-1])[::-1]
        k = min(range(len(down)), key=lambda j: down[j] + up[j])
        return _ops(ref[:half], hyp[:k]) + _ops(ref[half:], hyp[k:])
    table = [(free, down) for free, down, _, _ in _columns(_places(ref), len(ref), hyp)]
    i, j, steps = len(ref) - 1, len(hyp) - 1, []
    while i >= 0 and j >= 0:
        same, (free, down) = ref[i] == hyp[j], table[j]
        if same or not free >> i & 1:
            steps.append("e" if same else "s")
            i, j = i - 1, j - 1
        elif down >> i & 1:
            steps.append("d")
            i -= 1
        else:
            steps.append("i")
            j -= 1
    return "".join(reversed(steps + ["d"] * (i + 1) + ["i"] * (j + 1)))


def _straight(ref: Sequence[str], hyp: Sequence[str]) -> str | None:
    """``_ops`` of sides of one length that differ in no more places than in words, whatever their order; else null.

    No alignment is shorter then, at no beginning of the sides either, so that from the end each step is a diagonal one.
    """
    if len(ref) != len(hyp):
        return None
    apart = sum(map(ne, ref, hyp))
    if apart and apart > (Counter(ref) - Counter(hyp)).total():
        return None
    return "".join("e" if r == h else "s" for r, h in zip(ref, hyp))


def align(ref: Sequence[str], hyp: Sequence[str]) -> dict:
    """Counts and maximal chunks of one kind; two empty sides have none."""
    steps = _straight(ref, hyp)
    if steps is None:
        steps = _ops(ref, hyp)
    chunks, i, j = [], 0, 0
    for kind, run in groupby(steps):
        n = len(list(run))
        k, m = i + n * (kind != "i"), j + n * (kind != "d")
        chunks.append({"op": NAMES[kind], "ref_start": i, "ref_end": k, "hyp_start": j, "hyp_end": m})
        i, j = k, m
    return {"substitutions": steps.count("s"), "deletions": steps.count("d"), "insertions": steps.count("i"), "hits": steps.count("e"), "chunks": chunks}


@arrow(SCORE)
def alignment(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """``align`` of two columns of word arrays; null counts as empty."""
    return pd.DataFrame([align([] if r is None else list(r), [] if h is None else list(h)) for r, h in zip(ref, hyp)], columns=["substitutions", "deletions", "insertions", "hits", "chunks"])


def token_hits(chunks: Column, side: str) -> Column:
    """For each token of ``side`` (``ref`` or ``hyp``), whether it is part of an equal chunk."""
    return F.flatten(F.transform(chunks, lambda c: F.array_repeat(c.op == "equal", c[f"{side}_end"] - c[f"{side}_start"])))


def difference(chunks: Column, ref: Column, hyp: Column) -> Column:
    """Equal words plain, others as ``[ref→hyp]``, ``[-ref]`` or ``[+hyp]``."""
    return bound(_difference, chunks, ref, hyp)


def _difference(chunks: Column, ref: Column, hyp: Column) -> Column:
    def words(c: Column) -> Column:
        r, h = F.slice(ref, c.ref_start + 1, c.ref_end - c.ref_start), F.slice(hyp, c.hyp_start + 1, c.hyp_end - c.hyp_start)
        return (
            F.when(c.op == "equal", r)
            .when(c.op == "substitute", F.zip_with(r, h, lambda x, y: F.concat(F.lit("["), x, F.lit("→"), y, F.lit("]"))))
            .when(c.op == "delete", F.transform(r, lambda x: F.concat(F.lit("[-"), x, F.lit("]"))))
            .otherwise(F.transform(h, lambda y: F.concat(F.lit("[+"), y, F.lit("]"))))
        )

    return F.array_join(F.flatten(F.transform(chunks, words)), " ")


def aligned_words(chunks: Column, hyp: Column, start: Column, end: Column) -> Column:
    """Hypothesis words of reference words [start, end): one to one in chunks of equal length, insertions only strictly inside."""

    def words(c: Column) -> Column:
        lo, hi = F.greatest(start, c.ref_start), F.least(end, c.ref_end)
        paired = c.op.isin("equal", "substitute") & (lo < hi)
        inside = (c.op == "insert") & (start < c.ref_start) & (c.ref_start < end)
        return (
            F.when(paired, F.slice(hyp, c.hyp_start + lo - c.ref_start + 1, F.when(paired, hi - lo).otherwise(0)))
            .when(inside, F.slice(hyp, c.hyp_start + 1, c.hyp_end - c.hyp_start))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.flatten(F.transform(chunks, words))


def paired_words(chunks: Column, hyp: Column, size: Column) -> Column:
    """For each of ``size`` reference words (before, word): the hypothesis word beside it, if any, and the words inserted before it, both as text.

    ``aligned_words`` of a stretch are these words, with what is before them except for the first; made once, it isn't searched for each stretch.
    """
    none = F.array().cast("array<string>")

    def of(c: Column, k: Column) -> Column:
        previous, n = F.get(chunks, k - 1), F.when(c.op == "insert", 0).otherwise(c.ref_end - c.ref_start)
        inserted = F.when(previous.op == "insert", F.array_join(F.slice(hyp, previous.hyp_start + 1, previous.hyp_end - previous.hyp_start), "")).otherwise("")
        words = F.when(c.op.isin("equal", "substitute"), F.slice(hyp, c.hyp_start + 1, n)).when(c.op == "delete", F.array_repeat(F.lit(""), n)).otherwise(none)
        return F.transform(words, lambda w, i: F.struct(F.when(i == 0, inserted).otherwise("").alias("before"), w.alias("word")))

    return F.slice(F.flatten(F.transform(chunks, of)), 1, size)


def key_term_insertions(chunks: Column, hyp: Column, terms: Column) -> Column:
    """(term, n) for each term of words: its places in the hypothesis, overlaps included, that aren't wholly equal."""
    return bound(_insertions, token_hits(chunks, "hyp"), hyp, terms)


def _insertions(hits: Column, hyp: Column, terms: Column) -> Column:
    def places(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(hyp) - F.size(t), F.lit(0)))
        wrong = F.filter(starts, lambda i: (F.slice(hyp, i + 1, F.size(t)) == t) & F.exists(F.slice(hits, i + 1, F.size(t)), lambda x: ~x))
        return F.struct(F.array_join(t, " ").alias("term"), F.size(wrong).cast("bigint").alias("n"))

    return F.transform(F.filter(terms, lambda t: F.size(t) > 0), places)
