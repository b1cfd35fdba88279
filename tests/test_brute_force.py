"""Queries against plain Python over the driver's smallest tables: what one formula in two dialects can't show."""

import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vocalith.operators.alignment import distances
from vocalith.plans.dialect import Spark
from vocalith.plans.evaluation import BY_WORDS, CLUSTERS, QUERIES, RESAMPLES, scores

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def h(text, digits):
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def scored(session):
    rows = []
    for c in session.read.parquet(f"{SF}/conversations.parquet").collect():
        for i, raw in enumerate(re.split(r"[.!?\n]+", c.text or "")):
            toks = [w for w in re.sub(r"[^\w ]|_", " ", raw.lower()).split(" ") if w]
            utt = f"conv:{c.conv_id}:{c.turn}:{i}"
            for s in ("s1", "s2", "s3", "noisy"):
                drop, sub = (hashlib.md5(f"{x}:{s}{utt}".encode()).hexdigest() for x in ("drop", "sub"))
                kept = [w for k, w in enumerate(toks) if drop[k % 32] != "0"]
                hyp = ["zz" if sub[k % 32] == "0" else w for k, w in enumerate(kept)]
                rows.append((utt, c.conv_id % CLUSTERS, c.role, s, len(toks), len(hyp), distance(toks, hyp)))
    return rows


def run(session, name):
    return session.sql(QUERIES[name](Spark(SF, session))).collect()


def test_error_rates(session, scored):
    sums, each, n = defaultdict(lambda: [0, 0]), defaultdict(list), 0
    for _, _, subset, s, n_ref, _, e in scored:
        if s != "noisy":
            sums[subset, s][0] += e
            sums[subset, s][1] += n_ref
            if n_ref:
                each[subset, s].append(e / n_ref)
    got = {(r.subset, r.sys): (r.errors, r.n_ref, r.pooled_wer, r.mean_utt_wer) for r in run(session, "pooled_wer")}
    assert got.keys() == sums.keys()
    for k, (e, n, pooled, mean) in got.items():
        assert (e, n) == tuple(sums[k]) and abs(pooled - e / n) < 1e-7 and abs(mean - np.mean(each[k])) < 1e-7


def test_paired_bootstrap_holm_and_verdicts(session, scored):
    per = defaultdict(lambda: np.zeros(2))
    for _, c, _, s, n, _, e in scored:
        per[s, c] += (e, n)
    clusters = sorted({c for _, c in per})
    k = len(clusters)
    draws = np.zeros((RESAMPLES, k))
    for b in range(RESAMPLES):
        for j in range(k):
            draws[b, h(f"7:{b}:{j}", 8) % k] += 1
    rate = {s: (draws @ np.array([per[s, c][0] for c in clusters])) / (draws @ np.array([per[s, c][1] for c in clusters])) for s in ("s1", "s2", "s3")}
    whole = {s: sum(per[s, c][0] for c in clusters) / sum(per[s, c][1] for c in clusters) for s in rate}
    want = {}
    for a, b in (("s1", "s2"), ("s1", "s3"), ("s2", "s3")):
        d = rate[b] - rate[a]
        want[a, b] = [whole[b] - whole[a], *np.quantile(d, [0.025, 0.975]), min(1, 2 * (min((d <= 0).sum(), (d >= 0).sum()) + 1) / (RESAMPLES + 1))]
    top = 0.0
    for i, key in enumerate(sorted(want, key=lambda x: (want[x][3], x))):
        top = max(top, min(1, (3 - i) * want[key][3]))
        want[key].append(top)
    for r in run(session, "paired_differences"):
        w = want[r.sys_a, r.sys_b]
        assert np.allclose([r.estimate, r.low, r.high, r.p, r.holm_p], w, atol=1e-7) and r.speakers == k and r.dropped == 0
        assert r.verdict == (f"{r.sys_a} better" if w[1] > 0 else f"{r.sys_b} better" if w[2] < 0 else "tie") and r.distinguishable == (w[1] > 0 or w[2] < 0)
    for r in run(session, "bootstrap_intervals"):
        assert np.allclose([r.estimate, r.low, r.high], [whole[r.sys], *np.quantile(rate[r.sys], [0.025, 0.975])], atol=1e-7)


def events(session):
    by = defaultdict(list)
    for e in sorted(session.read.parquet(f"{SF}/events.parquet").collect(), key=lambda e: (e.ts, e.event_id)):
        by[e.user_id].append(e)
    return by


def test_session_latency(session):
    want = {}
    for user, es in events(session).items():
        t = lambda e: (e.ts - es[0].ts).total_seconds() * 1000  # noqa: B023, E731
        anchor = min((t(e) for e in es if e.event_type == "signup"), default=None)
        after = lambda kind: [t(e) for e in es if e.event_type == kind and anchor is not None and t(e) >= anchor]  # noqa: B023, E731
        row = []
        for kind, pick in (("click", min), ("purchase", max), ("view", min)):
            found = after(kind)
            row += ["missing" if anchor is None else "ok" if found else "timeout", round(pick(found) - anchor, 3) if found else None]
        want[user] = (*row, sum(e.event_type == "view" and anchor is not None and t(e) < anchor for e in es))
    got = {r.user_id: (r.partial_status, r.first_partial_ms, r.ttfs_status, r.ttfs_ms, r.endpoint_status, r.endpoint_ms, r.premature) for r in run(session, "session_latency")}
    assert got.keys() == want.keys()
    for u in got:
        assert all(a == b or abs(a - b) < 0.01 for a, b in zip(got[u], want[u]))


def test_speech_segments(session):
    want = set()
    for user, es in events(session).items():
        on, runs = False, []
        for i, e in enumerate(es):
            p = e.value / 400
            on = p >= 0.5 or on and p >= 0.35
            if on:
                if runs and runs[-1][1] == i:
                    runs[-1][1] = i + 1
                else:
                    runs.append([i, i + 1])
        merged = []
        for a, z in runs:
            if merged and a - merged[-1][1] < 3:
                merged[-1][1] = z
            else:
                merged.append([a, z])
        want |= {(user, a, z) for a, z in merged if z - a >= 2}
    assert {(r.user_id, r.first_frame, r.end_frame) for r in run(session, "speech_segments")} == want


def test_windows_of_an_hour(session):
    by = defaultdict(list)
    for e in session.read.parquet(f"{SF}/events.parquet").collect():
        by[e.event_type].append(e.ts.timestamp())
    want = {}
    for k, ts in by.items():
        ts = np.sort(np.array(ts))
        n = [int(((ts >= t - 3600) & (ts <= t)).sum()) for t in ts]
        want[k] = (max(n), sum(x > 5 for x in n))
    assert {r.event_type: (r.most_open, r.over_limit) for r in run(session, "rate_limit")} == want


def test_number_words(session):
    from vocalith.operators.scripts import words

    for r in run(session, "number_words"):
        assert r.words == words(r.n) and r.digits == " ".join(words(int(c)) for c in str(r.n))


def test_errors_of_pairs_with_many_different_words(session, tmp_path):
    """Beyond 94 different words a pair: the built-in distance and the aligner's agree with plain Python."""
    from vocalith.plans import frames

    words = [f"w{i}" for i in range(150)]
    session.createDataFrame([(1, k, "user", " ".join(words[k:] + words[:k])) for k in range(6)], "conv_id LONG, turn LONG, role STRING, text STRING").write.parquet(f"{tmp_path}/conversations.parquet")
    from vocalith.plans.dialect import Spark
    from vocalith.plans.evaluation import hyps, scores

    pairs = {(r.utt_id, r.sys): distance(r.toks, r.hyp) for r in session.sql(hyps(Spark(str(tmp_path), session))).collect()}
    assert {(r.utt_id, r.sys): r.errors for r in session.sql(scores(Spark(str(tmp_path), session))).collect()} == pairs and max(pairs.values()) > 0
    assert {(r.utt_id, r.sys): r.errors for r in frames.alignment_counts(session, str(tmp_path)).collect()} == pairs


def test_distances_of_batches_are_those_of_plain_tables(session):
    rng = random.Random(8)
    side = lambda: None if rng.random() < 0.1 else [rng.choice([*"abcdé", "zz", None]) for _ in range(rng.choice([0, 1, 2, 9, 40, 130]))]
    pairs = [(side(), side()) for _ in range(300)] + [([str(i) for i in range(200)], [str(i) for i in range(3, 203)])]
    kind = pa.list_(pa.string())
    got = distances(*(pa.array([None, *s, ["cut"]], kind)[1:-1] for s in zip(*pairs))).to_pylist()
    assert got == [None if r is None or h is None else distance(r, h) for r, h in pairs]
    assert distances(pa.array([], kind), pa.array([], kind)).to_pylist() == []
    plan = session.sql(scores(Spark(SF, session)))._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan  # before: words coded as characters, two thirds of the time of all queries on scores


@pytest.mark.parametrize("name", ["alignment_counts", *BY_WORDS])
def test_sql_counts_words_of_pairs_with_many_different_ones(session, tmp_path, name):
    """Before: from the 95th different word on, the SQL counted the bytes that words' codes have in common."""
    duckdb, entry = pytest.importorskip("duckdb"), __import__("__spark_entry__")
    words = [f"w{i}" for i in range(260)]
    session.createDataFrame([(c, k, "user", " ".join(words[k * 7 :] + words[: k * 7 : 2])) for c in range(3) for k in range(6)], "conv_id LONG, turn LONG, role STRING, text STRING").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    rel, df = db.sql(entry.oracle_sql()[name]), entry.queries()[name](session, str(tmp_path))
    assert sorted(map(tuple, df.select(rel.columns).collect())) == sorted(rel.fetchall()) != []
