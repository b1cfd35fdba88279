"""Intervals from Poisson resamples of histograms, against resamples of the values themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.operators import resampling as R


def _values(seed, clusters=40, timeouts=0.02):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(clusters):
        level = rng.normal(0, 0.4)
        for v in 300 * np.exp(level + rng.normal(0, 0.5, rng.integers(5, 60))):
            out.append((int(c), math.inf if rng.random() < timeouts else float(v)))
    return out


def _percentile(v, p):
    v = np.sort(v)
    return v[max(0, math.ceil(p * len(v) / 100) - 1)]


def _exact(values, draws, p, clustered):
    """The interval by drawing clusters (or values) with replacement and sorting what they hold."""
    rng, groups = np.random.default_rng(1), {}
    for c, v in values:
        groups.setdefault(c if clustered else len(groups), []).append(v)
    groups = [np.array(g) for g in groups.values()]
    found = [_percentile(np.concatenate([groups[i] for i in rng.integers(0, len(groups), len(groups))]), p) for _ in range(draws)]
    return _percentile(found, 2.5), _percentile(found, 97.5)


def test_intervals_are_those_of_exact_resamples_but_for_chance(session):
    values = _values(3)
    df = session.createDataFrame(values, "cluster BIGINT, v DOUBLE")
    got = R.latency_intervals(df, resamples=1000).first()
    assert (got.n, got.timeouts, got.speakers) == (len(values), sum(v == math.inf for _, v in values), 40)
    for p in (50, 95, 99):
        assert got[f"p{p}"] == _percentile([v for _, v in values], p)
    for p in (50, 95):
        low, high = _exact(values, 2000, p, True)
        # ends differ by the chance of a few hundred resamples and the width of a bin
        assert abs(got[f"low{p}"] / low - 1) < 0.06 and (got[f"high{p}"] == high or abs(got[f"high{p}"] / high - 1) < 0.06)
    low, high = _exact(values, 2000, 50, False)
    assert got.cluster_effect == pytest.approx((got.high50 - got.low50) / (high - low), rel=0.2)


def test_histograms_merge_and_do_not_follow_draws(session):
    values = _values(5, timeouts=0)
    df = session.createDataFrame(values, "cluster BIGINT, v DOUBLE")
    whole = {(r.b, r.bin): r.w for r in R.clustered(df, "s", 50).collect()}
    parts = {}
    for half in (df.where("cluster < 17"), df.where("cluster >= 17")):
        for r in R.clustered(half, "s", 50).collect():
            parts[r.b, r.bin] = parts.get((r.b, r.bin), 0) + r.w
    assert whole == {k: parts[k] for k in whole} and not any(parts[k] for k in parts.keys() - whole.keys())
    bins = len({b for _, b in whole})
    assert len(whole) == 50 * bins and bins < len({v for _, v in values})


def test_poisson_numbers_have_their_mean_and_spread(session):
    rows = session.range(4000).select(*[R.poisson(F.lit(m), "x", F.col("id"), str(m)).alias(f"m{m}") for m in (1, 5, 12, 13, 400)], R.poisson_one("y", F.col("id")).alias("one"))
    got = rows.toPandas()
    for m, name in ((1, "m1"), (5, "m5"), (12, "m12"), (13, "m13"), (400, "m400"), (1, "one")):
        assert abs(got[name].mean() - m) < 4 * math.sqrt(m / 4000) and abs(got[name].var() / m - 1) < 0.12 and got[name].min() >= 0
    for m in (1, 12):
        ladder = R._ladder(m)
        assert abs(ladder[0] - math.exp(-m)) < 1e-15 and 1 - ladder[-1] < 1e-11 and ladder == sorted(ladder)


def test_bins_and_percentiles_of_odd_values(session):
    rows = session.createDataFrame([(0.0,), (0.9,), (999.9,), (1000.0,), (12345.6,), (math.inf,)], "v DOUBLE")
    assert [r.b for r in rows.select(R.bin_of(F.col("v")).alias("b")).collect()] == [0, 0, 999, 1000, 12300, math.inf]
    df = session.createDataFrame([(1, 5.0)] * 7 + [(2, math.inf)] * 3, "cluster BIGINT, v DOUBLE")
    r = R.exact_percentiles(df, (50, 70, 71)).first()
    assert (r.n, r.p50, r.p70, r.p71) == (10, 5.0, 5.0, math.inf)
    none = R.latency_intervals(df.limit(0)).first()
    assert none.n is None and none.timeouts == 0 and none.low50 is None and none.cluster_effect is None


def test_percentiles_of_draws_are_exact(session):
    """Values that share three digits stay apart; numbers and draws are those of plain Python."""
    import hashlib

    from vocalith.operators.resampling import drawn, numbered, weighted_percentiles

    keys = sorted({k * k * 37 for k in range(300)})
    rows = [(k, float("inf") if n % 50 == 0 else 100_000.0 + n * 7.25) for n, k in enumerate(keys)]
    df = numbered(session.createDataFrame(rows, "key LONG, v DOUBLE"), "key")
    assert {r.key: (r.i, r.k) for r in df.collect()} == {k: (n, len(keys)) for n, k in enumerate(keys)}
    found = {r.b: (r.p50, r.p95) for r in weighted_percentiles(drawn(df, "9", 20).select("b", "v", "w"), (50, 95)).collect()}
    for b in range(20):
        v = sorted(rows[int(hashlib.md5(f"9:{b}:{j}".encode()).hexdigest()[:8], 16) % len(rows)][1] for j in range(len(rows)))
        assert found[b] == tuple(next(x for m, x in enumerate(v, 1) if m >= p / 100 * len(v)) for p in (50, 95))


def test_rows_that_are_drawn_do_not_pass_through_the_driver(session):
    """Before: the planner took all sessions for small enough to broadcast, twice, and the driver ran out of memory."""
    df = R.numbered(session.range(10).select(F.col("id").alias("key"), F.col("id").cast("double").alias("v")), "key")
    out = R.drawn(df, "9", 20)
    rows = out.collect()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.b for r in rows} == set(range(20)) and sum(r.w for r in rows) == 20 * 10
