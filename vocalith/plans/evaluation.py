"""The engine's queries, each a function of a dialect.

There is no speech in the tables at hand, so views stand in for it: the sentences of conversation turns are references,
hashes drop and replace their words to make hypotheses of several systems, and each user's events are a session's trace.
"""

from __future__ import annotations

Z95 = 1.959963984540054
#: Bootstrap draws of error rates, speakers that the tables at hand are dealt to, and how few are too few for a verdict.
RESAMPLES, CLUSTERS, FEW = 10_000, 20, 10
#: Bootstrap draws of percentiles.
DRAWS = 200
SYSTEMS = ("s1", "s2", "s3", "noisy")
#: Queries whose SQL counts the words of pairs of any number of different words; that of the others holds for up to 94.
BY_WORDS = ("changed_utterances", "group_stats", "pooled_wer", "rule_ablation", "utt_wer", "worst_utterances")
#: Outcome bounds in ms, the VAD's thresholds, gaps and lengths, and the share of speech below which a clip is flagged.
LATE_MS, ENTER, LEAVE, GAP, LEAST, LOW_COVERAGE = 3000, 0.5, 0.35, 3, 2, 0.3


def refs(d) -> str:
    """(utt_id, speaker_id, cluster, subset, raw, toks): every sentence of every turn, whole."""
    words = d.filter(d.split(d.replace("lower(s.raw)", r"[^\p{L}\p{N} ]", " "), " +"), "x", "x <> ''")
    cut = d.transform(d.split("coalesce(text, '')", r"[.!?\n]+"), "x, i", d.struct(i=d.index, raw="x"))
    turns = f"SELECT conv_id, turn, role, {d.explode(cut)} AS s FROM {d.table('conversations')}"
    named = f"SELECT 'conv:' || conv_id || ':' || turn || ':' || s.i AS utt_id, 'spk' || (conv_id % {CLUSTERS}) AS speaker_id, conv_id % {CLUSTERS} AS cluster, role AS subset, s FROM ({turns}) t0"
    return f"SELECT utt_id, speaker_id, cluster, subset, s.raw AS raw, {words} AS toks FROM ({d.deal(named, 'utt_id')}) t1"


def hyps(d, systems=("s1", "s2", "s3")) -> str:
    """References with every system's hypothesis: words go where one hash of the utterance has a 0 at their place, and become ``zz`` where another has."""
    digit = lambda h: f"substr({h}, cast({d.index} % 32 + 1 AS INT), 1)"
    kept = d.filter("toks", "x, i", f"{digit('drop_h')} <> '0'")
    subbed = d.transform(kept, "x, i", f"CASE WHEN {digit('sub_h')} = '0' THEN 'zz' ELSE x END")
    names = d.array(*(f"'{s}'" for s in systems))
    hashed = f"SELECT *, md5('drop:' || sys || utt_id) AS drop_h, md5('sub:' || sys || utt_id) AS sub_h FROM (SELECT *, {d.explode(names)} AS sys FROM ({refs(d)}) r0) r1"
    return f"SELECT utt_id, speaker_id, cluster, subset, raw, toks, sys, {subbed} AS hyp FROM ({hashed}) r2"


def _distance(d, a: str, b: str) -> str:
    """The edit distance of two word arrays, with ``dict`` their different words, each mapped to one character."""
    code = lambda x: f"{d.join}({d.transform(x, 'x', d.char(f'{d.position}(dict, x)'))}, '')"
    return d.words(a, b, f"cast(levenshtein({code(a)}, {code(b)}) AS BIGINT)")


def scores(d, systems=SYSTEMS[:3]) -> str:
    """(utt_id, ..., sys, n_ref, errors): the token edit distance of every system, computed once for all queries of a session.

    The checking engine's ``levenshtein`` compares bytes and so holds for up to 94 different words a pair, beyond which ``DuckWords`` makes the table's rows; Spark's side
    counts in batches of pairs: coding the words and the built-in distance took two thirds of the time.
    """
    sql = (
        f"SELECT utt_id, speaker_id, cluster, subset, sys, cast({d.size}(toks) AS BIGINT) AS n_ref, cast({d.size}(hyp) AS BIGINT) AS n_hyp, {d.distance('toks', 'hyp', _distance(d, 'toks', 'hyp'))} AS errors "
        f"FROM (SELECT *, {d.distinct}({d.concat_arrays}(toks, hyp)) AS dict FROM ({hyps(d, SYSTEMS)}) h0) h1"
    )
    return f"SELECT * FROM ({d.once('scores', sql)}) once WHERE sys IN ({', '.join(repr(s) for s in systems)})"


def utt_wer(d) -> str:
    return f"SELECT utt_id, sys, n_ref, errors, round(errors / nullif(n_ref, 0), 8) AS wer FROM ({scores(d)}) s"


def pooled_wer(d) -> str:
    return f"SELECT subset, sys, cast(sum(errors) AS BIGINT) AS errors, cast(sum(n_ref) AS BIGINT) AS n_ref, round(sum(errors) / nullif(sum(n_ref), 0), 8) AS pooled_wer, round(avg(errors / nullif(n_ref, 0)), 8) AS mean_utt_wer FROM ({scores(d)}) s GROUP BY subset, sys"


def group_stats(d) -> str:
    return (
        f"SELECT coalesce(subset, 'All') AS grp, sys, count(*) AS n, cast(count_if(n_hyp = 0 AND n_ref > 0) AS BIGINT) AS empty_on_speech, cast(count_if(n_ref > 0) AS BIGINT) AS n_speech, cast(sum(errors) AS BIGINT) AS errors, cast(sum(n_ref) AS BIGINT) AS n_ref "
        f"FROM ({scores(d)}) s GROUP BY GROUPING SETS ((sys), (subset, sys))"
    )


def paired_coverage(d) -> str:
    """Runs lose some utterances; only those that every run covers are paired, and the rest is counted."""
    run = f"SELECT utt_id, subset, sys FROM ({scores(d)}) s WHERE {d.hex_int("'cover:' || sys || utt_id", 4)} % 17 <> 0"
    covered = f"SELECT utt_id FROM ({run}) r GROUP BY utt_id HAVING count(DISTINCT sys) = 3"
    return f"SELECT u.subset, count(*) AS scorable, cast(count_if(c.utt_id IS NOT NULL) AS BIGINT) AS covered, cast(count_if(c.utt_id IS NULL) AS BIGINT) AS not_covered FROM ({refs(d)}) u LEFT JOIN ({covered}) c ON u.utt_id = c.utt_id GROUP BY u.subset"


def exclusions(d) -> str:
    """Reasons in order of precedence, on documents as transcripts."""
    reason = "CASE WHEN text LIKE '%All rights reserved%' THEN 'unintelligible' WHEN text LIKE '%@%' THEN 'inaudible' WHEN length(text) < 300 THEN 'too_short' END"
    return f"SELECT reason, count(*) AS n FROM (SELECT {reason} AS reason FROM {d.table('documents')}) x WHERE reason IS NOT NULL GROUP BY reason"


def worst_utterances(d) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY sys ORDER BY errors DESC, utt_id) AS rk FROM ({scores(d)}) s"
    return f"SELECT sys, cast(rk AS BIGINT) AS rk, utt_id, errors, n_ref FROM ({ranked}) r WHERE rk <= 10 AND errors > 0"


def changed_utterances(d) -> str:
    both = f"SELECT utt_id, max(CASE WHEN sys = 's1' THEN errors END) AS before, max(CASE WHEN sys = 's2' THEN errors END) AS after FROM ({scores(d, ('s1', 's2'))}) s GROUP BY utt_id"
    return f"SELECT utt_id, before, after, after - before AS delta FROM ({both}) x WHERE before <> after ORDER BY delta DESC, utt_id LIMIT 8"


def _draws(d, clusters: str, resamples: int, name: str = "7") -> str:
    """(b, cluster, w): how often resample b draws each of ``clusters`` (cluster, i, k), i from 0 to k - 1: as many draws as clusters, by hash."""
    slots = f"SELECT b, i AS j, k FROM (SELECT {d.explode(d.sequence('0', str(resamples - 1)))} AS b) b0 CROSS JOIN ({clusters}) c0"
    drawn = f"SELECT b, {d.hex_int(f"'{name}:' || b || ':' || j", 8)} % k AS i FROM ({slots}) s0"
    return f"SELECT b, cluster, w FROM (SELECT b, i, count(*) AS w FROM ({drawn}) s1 GROUP BY b, i) s2 JOIN ({clusters}) c1 ON s2.i = c1.i"


def _numbered(sql: str) -> str:
    """(cluster, i, k) of the different clusters of ``sql``, a row a speaker."""
    return f"SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT cluster FROM ({sql}) x0) x1"


def _pivoted(d, systems) -> str:
    """(cluster, n_<sys>, e_<sys>): words and errors of every system, a row a speaker."""
    sums = ", ".join(f"sum(CASE WHEN sys = '{s}' THEN errors END) AS e_{s}, sum(CASE WHEN sys = '{s}' THEN n_ref END) AS n_{s}" for s in systems)
    return d.once("per_speaker", f"SELECT cluster, {sums} FROM ({scores(d, systems)}) s GROUP BY cluster")


def _resampled(d, systems=SYSTEMS[:3]) -> str:
    """(b, <sys> ...): every system's pooled error rate on resample b, all on the same draws; null where a resample has no words."""
    per = _pivoted(d, systems)
    rates = ", ".join(f"sum(w * e_{s}) / nullif(sum(w * n_{s}), 0) AS {s}" for s in systems)
    return d.once("resampled", f"SELECT b, {rates} FROM ({per}) p JOIN ({_draws(d, _numbered(per), RESAMPLES)}) r ON p.cluster = r.cluster GROUP BY b")


def bootstrap_intervals(d) -> str:
    """Pooled error rate of every system, its interval over resampled speakers, and how many resamples had no words."""
    each = " UNION ALL ".join(f"SELECT '{s}' AS sys, {s} AS wer FROM ({_resampled(d)}) x" for s in SYSTEMS[:3])
    q = lambda p: f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY wer), 8)"
    spread = f"SELECT sys, {q(0.025)} AS low, {q(0.975)} AS high, count(wer) AS resamples, count(*) - count(wer) AS dropped FROM ({each}) y GROUP BY sys"
    point = f"SELECT sys, round(sum(errors) / nullif(sum(n_ref), 0), 8) AS estimate, count(DISTINCT cluster) AS speakers FROM ({scores(d)}) s GROUP BY sys"
    return f"SELECT a.sys, estimate, low, high, resamples, dropped, speakers FROM ({point}) a JOIN ({spread}) b ON a.sys = b.sys"


def paired_differences(d) -> str:
    """All pairs of systems: difference, interval and p on shared resamples, Holm's adjustment, and the verdict.

    The interval alone makes a pair distinguishable; too few speakers make no verdict at all.
    """
    names = SYSTEMS[:3]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    diffs = " UNION ALL ".join(f"SELECT '{a}' AS sys_a, '{b}' AS sys_b, {b} - {a} AS diff FROM ({_resampled(d)}) x" for a, b in pairs)
    point = " UNION ALL ".join(f"SELECT '{a}' AS sys_a, '{b}' AS sys_b, sum(e_{b}) / sum(n_{b}) - sum(e_{a}) / sum(n_{a}) AS estimate, count(*) AS speakers FROM ({_pivoted(d, names)}) x" for a, b in pairs)
    q = lambda p: f"percentile_cont({p}) WITHIN GROUP (ORDER BY diff)"
    spread = f"SELECT sys_a, sys_b, {q(0.025)} AS low, {q(0.975)} AS high, least(1e0, 2e0 * (least(count_if(diff <= 0), count_if(diff >= 0)) + 1) / (count(diff) + 1)) AS p, count(*) - count(diff) AS dropped FROM ({diffs}) x GROUP BY sys_a, sys_b"
    ranked = f"SELECT y.*, v.estimate, v.speakers, row_number() OVER (ORDER BY p, y.sys_a, y.sys_b) - 1 AS rk, count(*) OVER () AS m FROM ({spread}) y JOIN ({point}) v ON y.sys_a = v.sys_a AND y.sys_b = v.sys_b"
    holm = f"SELECT *, max(least(1e0, (m - rk) * p)) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS holm_p FROM ({ranked}) z"
    verdict = f"CASE WHEN speakers < {FEW} THEN 'too few speakers (' || speakers || ') to call' WHEN low > 0 THEN sys_a || ' better' WHEN high < 0 THEN sys_b || ' better' ELSE 'tie' END"
    return f"SELECT sys_a, sys_b, round(estimate, 8) AS estimate, round(low, 8) AS low, round(high, 8) AS high, round(p, 8) AS p, round(holm_p, 8) AS holm_p, (low > 0 OR high < 0) AS distinguishable, {verdict} AS verdict, speakers, dropped FROM ({holm}) w"


def wilson_by_event(d) -> str:
    z, z2 = f"{Z95}e0", Z95 * Z95
    counts = f"SELECT event_type, count(*) AS n, cast(count_if(value > 50) AS BIGINT) AS k FROM {d.table('events')} GROUP BY event_type"
    mid, half = f"(k + {z2 / 2}e0) / (n + {z2}e0)", f"{z} / (n + {z2}e0) * sqrt(k * (n - k) / cast(n AS DOUBLE) + {z2 / 4}e0)"
    return f"SELECT event_type, n, k, round(k / n, 8) AS estimate, round(greatest(0, {mid} - {half}), 8) AS low, round(least(1, {mid} + {half}), 8) AS high FROM ({counts}) c"


def _children(d) -> str:
    """Augmented utterances beside their parents: (parent, speaker, cluster, excluded, covered, clean, noisy, n_ref)."""
    excluded = f"{d.hex_int("'excl:' || utt_id", 4)} % 23 = 0"
    covered = f"{d.hex_int("'lost:' || utt_id", 4)} % 19 <> 0"
    both = f"SELECT utt_id, min(cluster) AS cluster, max(n_ref) AS n_ref, max(CASE WHEN sys = 's1' THEN errors END) AS clean, max(CASE WHEN sys = 'noisy' THEN errors END) AS noisy FROM ({scores(d, ('s1', 'noisy'))}) s GROUP BY utt_id"
    children = f"SELECT utt_id || '#mulaw' AS utt_id, utt_id AS parent_utt_id, noisy FROM ({both}) c0 WHERE {covered}"
    parents = f"SELECT utt_id, cluster, n_ref, clean, {excluded} AS excluded FROM ({both}) p0"
    return d.once("children", f"SELECT p.utt_id AS parent, p.cluster, p.n_ref, p.clean, c.noisy, p.excluded FROM ({parents}) p LEFT JOIN ({children}) c ON c.parent_utt_id = p.utt_id")


def degradation(d) -> str:
    """Augmented less clean on pairs of a child and its parent that both runs cover: rates, the difference with its interval and p over
    resampled speakers, and what dropped out. Children of excluded parents don't count."""
    pairs = f"SELECT cluster, sum(n_ref) AS n, sum(clean) AS c, sum(noisy) AS a FROM ({_children(d)}) x WHERE NOT excluded AND noisy IS NOT NULL GROUP BY cluster"
    drawn = f"SELECT b, sum(w * (a - c)) / nullif(sum(w * n), 0) AS diff FROM ({pairs}) p JOIN ({_draws(d, _numbered(pairs), RESAMPLES)}) r ON p.cluster = r.cluster GROUP BY b"
    q = lambda p: f"percentile_cont({p}) WITHIN GROUP (ORDER BY diff)"
    spread = f"SELECT {q(0.025)} AS low, {q(0.975)} AS high, least(1e0, 2e0 * (least(count_if(diff <= 0), count_if(diff >= 0)) + 1) / (count(diff) + 1)) AS p FROM ({drawn}) y"
    counts = f"SELECT cast(count_if(NOT excluded) AS BIGINT) AS parents, cast(count_if(excluded) AS BIGINT) AS excluded, cast(count_if(NOT excluded AND noisy IS NULL) AS BIGINT) AS dropped FROM ({_children(d)}) x"
    point = f"SELECT count(*) AS speakers, sum(c) / sum(n) AS clean, sum(a) / sum(n) AS augmented, sum(a) / nullif(sum(c), 0) - 1e0 AS relative FROM ({pairs}) p"
    return f"SELECT parents, excluded, dropped, speakers, round(clean, 8) AS clean, round(augmented, 8) AS augmented, round(augmented - clean, 8) AS difference, round(low, 8) AS low, round(high, 8) AS high, round(p, 8) AS p, round(relative, 8) AS relative FROM ({counts}) x CROSS JOIN ({point}) y CROSS JOIN ({spread}) z"


def speaker_sample(d) -> str:
    ranked = f"SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {d.sha256("'13:' || doc_id")}, doc_id) AS rk FROM {d.table('documents')} WHERE length(text) >= 100"
    return f"SELECT doc_id, source, cast(rk AS BIGINT) AS rk FROM ({ranked}) r WHERE rk <= 3"


def sample_digest(d) -> str:
    ids = d.collect("cast(doc_id AS STRING)", "cast(doc_id AS STRING)")
    return f"SELECT source, count(*) AS n, {d.sha256(f"{d.join}({ids}, chr(10))")} AS digest FROM ({speaker_sample(d)}) s GROUP BY source"


def stratified_round_robin(d, n: int = 100, most: int = 3, least: int = 5) -> str:
    """Strata take turns; those with fewer than ``least`` members are pooled into one that takes one turn, and a speaker gives ``most`` members at most.

    Speakers are dealt to strata here, each in one, so the members that a speaker may give are ranked before the turns. Strata are counted by
    an aggregate, and no member beyond the ``n`` first of its stratum is sorted further.
    """
    named = f"SELECT doc_id, lang AS accent, source || '/' || lang AS speaker, {d.sha256("'5:' || doc_id")} AS h FROM {d.table('documents')}"
    sizes = f"SELECT accent AS a, count(*) AS members FROM ({named}) s0 GROUP BY accent"
    strata = f"SELECT doc_id, h, speaker, CASE WHEN members < {least} THEN 'OTHER' ELSE accent END AS stratum FROM ({named}) s1 JOIN ({sizes}) s2 ON accent = a OR accent IS NULL AND a IS NULL"
    given = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY h, doc_id) AS given FROM ({strata}) t0) t1 WHERE given <= {most}"
    turn = f"SELECT * FROM (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id) AS turn FROM ({given}) t2) t3 WHERE turn <= {n}"
    return f"SELECT doc_id, stratum, cast(turn AS BIGINT) AS turn FROM ({turn}) t4 ORDER BY turn, stratum LIMIT {n}"


def sessions(d) -> str:
    """One row a session with what its events say about latency, times in ms since its first event."""
    ev = f"SELECT user_id, event_type, event_id, ({d.us('ts')} - min({d.us('ts')}) OVER (PARTITION BY user_id)) / 1000e0 AS ms FROM {d.table('events')}"
    anchored = f"SELECT *, min(CASE WHEN event_type = 'signup' THEN ms END) OVER (PARTITION BY user_id) AS anchor FROM ({ev}) e"
    return (
        "SELECT user_id, min(anchor) AS anchor, count(*) AS n_events, min(CASE WHEN event_type = 'click' AND ms >= anchor THEN ms END) AS first_partial, "
        "max(CASE WHEN event_type = 'purchase' AND ms >= anchor THEN ms END) AS last_final, min(CASE WHEN event_type = 'purchase' AND ms >= anchor THEN ms END) AS first_final, "
        "min(CASE WHEN event_type = 'view' AND ms >= anchor THEN ms END) AS endpoint, cast(count_if(event_type = 'view' AND ms < anchor) AS BIGINT) AS premature, "
        f"cast(count_if(event_type = 'error') AS BIGINT) AS errors FROM ({anchored}) a GROUP BY user_id"
    )


def session_latency(d) -> str:
    status = lambda x: f"CASE WHEN anchor IS NULL THEN 'missing' WHEN {x} IS NULL THEN 'timeout' ELSE 'ok' END"
    return f"SELECT user_id, {status('first_partial')} AS partial_status, round(first_partial - anchor, 3) AS first_partial_ms, {status('last_final')} AS ttfs_status, round(last_final - anchor, 3) AS ttfs_ms, {status('endpoint')} AS endpoint_status, round(endpoint - anchor, 3) AS endpoint_ms, premature FROM ({sessions(d)}) s"


def _values(d) -> str:
    """(user_id, cluster, v): each session's time to the first final, infinite where none came; sessions without an anchor are left out."""
    return f"SELECT user_id, user_id % {CLUSTERS} AS cluster, coalesce(cast(first_final - anchor AS DOUBLE), {d.infinity()}) AS v FROM ({sessions(d)}) s WHERE anchor IS NOT NULL"


def latency_values(d) -> str:
    """(user_id, cluster, v) of every session, v null where there is no anchor."""
    return f"SELECT user_id, user_id % {CLUSTERS} AS cluster, CASE WHEN anchor IS NOT NULL THEN coalesce(cast(first_final - anchor AS DOUBLE), {d.infinity()}) END AS v FROM ({sessions(d)}) s"


def _percentiles(d, values: str, clusters: str, name: str) -> str:
    """(b, p50, p95, p99) of ``values`` (cluster, v) on resamples of its clusters: the least value up to which that share of the draws lies.

    A draw is a weight of its cluster's values, which are sorted once a resample."""
    drawn = f"SELECT b, v, sum(w) AS w FROM ({values}) v0 JOIN ({_draws(d, clusters, DRAWS, name)}) r0 ON v0.cluster = r0.cluster GROUP BY b, v"
    sums = f"SELECT b, v, sum(w) OVER (PARTITION BY b ORDER BY v) AS upto, sum(w) OVER (PARTITION BY b) AS whole FROM ({drawn}) d0"
    at = ", ".join(f"min(CASE WHEN upto >= {p / 100}e0 * whole THEN v END) AS p{p}" for p in (50, 95, 99))
    return f"SELECT b, {at} FROM ({sums}) d1 GROUP BY b"


def _spread(p: int, b: str) -> str:
    """The interval of a percentile over its resamples, by the same rule; an upper end may be infinite."""
    return f"percentile_disc(0.025) WITHIN GROUP (ORDER BY {b}p{p}) AS low{p}, percentile_disc(0.975) WITHIN GROUP (ORDER BY {b}p{p}) AS high{p}"


def latency_by_draws(d) -> str:
    """Percentiles of sessions' latencies, a timeout being infinite, with intervals over resampled speakers; what was left out; and
    how much wider the median's interval is than one over resampled sessions."""
    v, alone = _values(d), f"SELECT user_id AS cluster, v FROM ({_values(d)}) a0"
    q = lambda p: f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY v) AS p{p}"
    point = f"SELECT count(*) AS n, cast(count_if(v = {d.infinity()}) AS BIGINT) AS timeouts, count(DISTINCT cluster) AS speakers, {', '.join(map(q, (50, 95, 99)))} FROM ({v}) x"
    missing = f"SELECT cast(count_if(anchor IS NULL) AS BIGINT) AS excluded FROM ({sessions(d)}) s"
    wide = f"SELECT {', '.join(_spread(p, '') for p in (50, 95, 99))} FROM ({_percentiles(d, v, _numbered(v), '8')}) y"
    narrow = f"SELECT {_spread(50, '')} FROM ({_percentiles(d, alone, _numbered(alone), '9')}) z"
    effect = f"CASE WHEN w.high50 < {d.infinity()} AND a.high50 < {d.infinity()} AND a.high50 > a.low50 THEN round((w.high50 - w.low50) / (a.high50 - a.low50), 8) END"
    return f"SELECT n, timeouts, excluded, speakers, p50, w.low50, w.high50, p95, low95, high95, p99, low99, high99, {effect} AS cluster_effect FROM ({point}) p CROSS JOIN ({missing}) m CROSS JOIN ({wide}) w CROSS JOIN ({narrow}) a"


def speaker_latency(d) -> str:
    q = lambda p: f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)"
    return f"SELECT cluster, count(*) AS n, cast(count_if(v = {d.infinity()}) AS BIGINT) AS timeouts, {q(0.5)} AS p50, {q(0.95)} AS p95, {q(0.99)} AS p99 FROM ({_values(d)}) x GROUP BY cluster"


def _outcomes(d) -> str:
    """Sessions with their outcome; the tables' events are minutes apart, so a minute stands for a millisecond here."""
    return f"SELECT *, CASE WHEN anchor IS NULL THEN 'unscorable' WHEN premature > 0 THEN 'premature' WHEN (endpoint - anchor) / 60000e0 <= {LATE_MS} THEN 'correct' ELSE 'late' END AS outcome FROM ({sessions(d)}) s"


def endpoint_outcomes(d) -> str:
    """Outcomes' shares of the scorable sessions with Wilson's interval, and the delay's median and 95th percentile where correct."""
    z2 = Z95 * Z95
    counts = f"SELECT outcome, count(*) AS k, percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN outcome = 'correct' THEN endpoint - anchor END) AS d50, percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN outcome = 'correct' THEN endpoint - anchor END) AS d95 FROM ({_outcomes(d)}) o GROUP BY outcome"
    n = f"SELECT *, sum(CASE WHEN outcome <> 'unscorable' THEN k ELSE 0 END) OVER () AS n FROM ({counts}) c"
    mid, half = f"(k + {z2 / 2}e0) / (n + {z2}e0)", f"{Z95}e0 / (n + {z2}e0) * sqrt(k * (n - k) / cast(n AS DOUBLE) + {z2 / 4}e0)"
    rate = lambda x: f"CASE WHEN outcome <> 'unscorable' AND n > 0 THEN round({x}, 8) END"
    return f"SELECT outcome, k, {rate('k / cast(n AS DOUBLE)')} AS rate, {rate(f'greatest(0, {mid} - {half})')} AS low, {rate(f'least(1, {mid} + {half})')} AS high, round(d50, 3) AS delay_p50, round(d95, 3) AS delay_p95 FROM ({n}) x"


def rate_limit(d) -> str:
    """The most session opens in any 60-minute sliding window, for each event type.

    Hours of a type are windows of their own: an event counts in its own hour and is copied into the next one, where it only counts for others.
    """
    ev = f"SELECT event_type, cast({d.us('ts')} AS BIGINT) AS us, cast(floor({d.us('ts')} / 3600000000e0) AS BIGINT) AS hour FROM {d.table('events')}"
    both = f"SELECT event_type, us, hour, true AS own FROM ({ev}) e0 UNION ALL SELECT event_type, us, hour + 1 AS hour, false AS own FROM ({ev}) e1"
    counted = f"SELECT event_type, own, count(*) OVER (PARTITION BY event_type, hour ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS open_now FROM ({both}) e2"
    return f"SELECT event_type, cast(max(open_now) AS BIGINT) AS most_open, cast(count_if(open_now > 5) AS BIGINT) AS over_limit FROM ({counted}) c WHERE own GROUP BY event_type"


def pacing(d) -> str:
    """Lateness at positions min(n - 1, floor(p n)) of the sorted values, and the share above 5. Equal values are counted before they are sorted."""
    counts = f"SELECT event_type, value, count(*) AS k FROM {d.table('events')} GROUP BY event_type, value"
    v = f"SELECT event_type, value, k, sum(k) OVER (PARTITION BY event_type ORDER BY value) AS upto, sum(k) OVER (PARTITION BY event_type) AS n FROM ({counts}) c"
    q = lambda p: f"min(CASE WHEN upto > least(n - 1, cast(floor({p} * n) AS BIGINT)) THEN value END)"
    return f"SELECT event_type, {q('0.1')} AS p10, {q('0.5')} AS p50, {q('0.9')} AS p90, max(value) AS most, round(sum(k * value) / sum(k), 6) AS mean, round(sum(CASE WHEN value > 5 THEN k ELSE 0 END) / sum(k), 8) AS over_5 FROM ({v}) x GROUP BY event_type"


def speech_segments(d) -> str:
    """Hysteresis over each user's values as probabilities: enter, stay until below the lower bound, merge short gaps, drop short segments."""
    p = f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value / 400e0 AS p FROM {d.table('events')}"
    mark = f"SELECT user_id, i, CASE WHEN p >= {ENTER} THEN 1 WHEN p < {LEAVE} THEN 0 END AS m FROM ({p}) a"
    run = f"SELECT user_id, i, coalesce({d.last('m')} OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS s FROM ({mark}) b"
    isle = f"SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM ({run}) c WHERE s = 1"
    seg = f"SELECT user_id, min(i) AS a, max(i) + 1 AS z FROM ({isle}) e GROUP BY user_id, g"
    new = f"SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY user_id ORDER BY a) < {GAP} THEN 0 ELSE 1 END AS fresh FROM ({seg}) f"
    num = f"SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM ({new}) h"
    return f"SELECT user_id, cast(min(a) AS BIGINT) AS first_frame, cast(max(z) AS BIGINT) AS end_frame FROM ({num}) l GROUP BY user_id, k HAVING max(z) - min(a) >= {LEAST}"


def speech_bounds(d) -> str:
    """Where speech begins and ends in a clip, within it; how much of it there is, and whether that is none or little."""
    clip = f"SELECT user_id, count(*) AS frames FROM {d.table('events')} GROUP BY user_id"
    part = "least(1e0, coalesce(sum(s.end_frame - s.first_frame), 0) / max(c.frames))"
    flag = f"CASE WHEN min(s.first_frame) IS NULL THEN 'no_speech' WHEN {part} < {LOW_COVERAGE}e0 THEN 'low_coverage' ELSE '' END"
    return f"SELECT c.user_id, c.frames * 32 AS clip_ms, cast(min(s.first_frame) * 32 AS BIGINT) AS speech_start_ms, cast(CASE WHEN min(s.first_frame) IS NOT NULL THEN least(max(s.end_frame), max(c.frames)) * 32 END AS BIGINT) AS speech_end_ms, round({part}, 4) AS coverage, {flag} AS flags FROM ({clip}) c LEFT JOIN ({speech_segments(d)}) s ON c.user_id = s.user_id GROUP BY c.user_id, c.frames"


def vad_join(d) -> str:
    """Sidecar against manifest: what misses a span, what has an unknown one; nothing is filled in."""
    side = f"SELECT doc_id FROM {d.table('labels')}"
    return f"SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'unknown' ELSE 'joined' END AS status, count(*) AS n FROM {d.table('documents')} m FULL OUTER JOIN ({side}) l ON m.doc_id = l.doc_id GROUP BY 1"


def transcripts(d) -> str:
    text = f"{d.join}({d.collect('text', 'turn')}, ' ')"
    return f"SELECT conv_id, count(*) AS turns, length({text}) AS n_chars, md5({text}) AS digest FROM {d.table('conversations')} WHERE role <> 'system' AND text IS NOT NULL GROUP BY conv_id"


def sent_at(d) -> str:
    """For each session and audio time, the first chunk that holds it: one conditional aggregate instead of a range join."""
    chunk = f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 20 AS off, {d.us('ts')} AS us FROM {d.table('events')}"
    return f"SELECT user_id, x AS audio_ms, cast(min(CASE WHEN off <= x AND x < off + 20 THEN us END) AS BIGINT) AS sent_us FROM (SELECT *, {d.explode(d.array('50', '333', '900'))} AS x FROM ({chunk}) c) y GROUP BY user_id, x"


def step_seeds(d) -> str:
    key = "'run:' || doc_id || ':0'"
    first = f"cast(conv(substr({d.sha256(key)}, 1, 15), 16, 10) AS BIGINT)" if type(d).__name__ == "Spark" else f"('0x' || substr({d.sha256(key)}, 1, 15))::BIGINT"
    last = f"cast(conv(substr({d.sha256(key)}, 16, 1), 16, 10) AS BIGINT)" if type(d).__name__ == "Spark" else f"('0x' || substr({d.sha256(key)}, 16, 1))::BIGINT"
    return f"SELECT doc_id, {first} * 8 + cast(floor({last} / 2) AS BIGINT) AS seed FROM {d.table('documents')}"


def knob_inference(d) -> str:
    """The one setting that varies among a config's runs, whatever the settings' keys are."""
    keys = "json_object_keys(settings)" if type(d).__name__ == "Spark" else "json_keys(settings)"
    value = "get_json_object(settings, '$.' || key)" if type(d).__name__ == "Spark" else "json_extract_string(settings, '$.' || key)"
    runs = f"SELECT event_type || ':' || (event_id % 7) AS config, '{{\"chunk_ms\": ' || (CASE WHEN event_id % 7 = 0 THEN event_id % 3 ELSE 20 END) || ', \"k\": ' || (CASE WHEN event_id % 7 < 5 THEN {d.json_int('props', 'k')} % 3 ELSE 1 END) || ', \"name\": \"' || event_type || '\"}}' AS settings FROM {d.table('events')}"
    pairs = f"SELECT config, key, count(DISTINCT {value}) AS kinds FROM (SELECT config, settings, {d.explode(keys)} AS key FROM ({runs}) r) x GROUP BY config, key"
    return f"SELECT config, min(CASE WHEN kinds > 1 THEN key END) AS knob, cast(max(kinds) AS BIGINT) AS kinds FROM ({pairs}) y GROUP BY config HAVING count_if(kinds > 1) = 1"


def sweep_points(d) -> str:
    """Runs of a sweep: one for each different value, its id without underscores, natural finalization; repeated values are refused."""
    base = f"SELECT c_custkey AS config, 'cfg_' || c_custkey AS config_id, {d.array("cast(c_acctbal AS VARCHAR(20))" if type(d).__name__ != 'Spark' else "cast(c_acctbal AS STRING)", "'-0.5'", "CASE WHEN c_custkey % 5 = 0 THEN '-0.5' ELSE 'True' END")} AS vals FROM {d.table('customer')}"
    fine = f"SELECT * FROM ({base}) b WHERE {d.size}({d.distinct}(vals)) = {d.size}(vals)"
    slug = "replace(replace(lower(v), '.', 'p'), '-', 'm')"
    return f"SELECT config_id, v, replace(config_id || '-eot_threshold-' || {slug}, '_', '-') AS run_id, 'natural' AS finalization FROM (SELECT config_id, {d.explode('vals')} AS v FROM ({fine}) f) x"


def sweep_table(d) -> str:
    rows = f"SELECT event_type AS config, {d.json_int('props', 'k')} % 4 AS knob_value, user_id, value FROM {d.table('events')}"
    return f"SELECT config, knob_value, config || '-k-' || knob_value AS run_id, count(*) AS n_rows, count(DISTINCT user_id) AS speakers, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS median_rtt, round(count_if(value > 100) / count(*), 8) AS premature_rate FROM ({rows}) r GROUP BY config, knob_value"


def resume_plan(d) -> str:
    """What is still to run: neither done nor failed before, unless failed ones are tried again."""
    done = f"SELECT doc_id, toxic = 1 AS failed FROM {d.table('labels')}"
    return f"SELECT count(*) AS scorable, cast(count_if(r.doc_id IS NULL) AS BIGINT) AS todo, cast(count_if(r.doc_id IS NULL OR r.failed) AS BIGINT) AS todo_retrying FROM {d.table('documents')} m LEFT JOIN ({done}) r ON m.doc_id = r.doc_id"


def boost_terms(d) -> str:
    """Lexicon from counted names: salts stripped, combinations dropped, counts merged, the first hundred."""
    name = d.replace("lower(trim(p_name))", " (red|blue|green)$", "")
    merged = f"SELECT {name} AS term, count(*) AS n FROM {d.table('part')} WHERE p_name NOT LIKE '% and %' GROUP BY 1"
    return f"SELECT term, n, cast(rk AS BIGINT) AS rk FROM (SELECT *, row_number() OVER (ORDER BY n DESC, term) AS rk FROM ({merged}) m) x WHERE rk <= 100"


def entity_recall(d) -> str:
    """References' long words as entities: recovered if the hypothesis has them as often, with Wilson intervals."""
    ent = d.filter("toks", "x", "length(x) >= 9")
    spans = f"SELECT sys, subset, toks, hyp, {d.explode(ent)} AS term FROM ({hyps(d)}) h"
    hit = f"SELECT sys, subset, {d.contains('hyp', 'term')} AS recovered FROM ({spans}) s"
    z, z2 = f"{Z95}e0", Z95 * Z95
    g = f"SELECT subset AS category, sys, count(*) AS n, cast(count_if(recovered) AS BIGINT) AS k FROM ({hit}) x GROUP BY subset, sys"
    mid, half = f"(k + {z2 / 2}e0) / (n + {z2}e0)", f"{z} / (n + {z2}e0) * sqrt(k * (n - k) / cast(n AS DOUBLE) + {z2 / 4}e0)"
    return f"SELECT category, sys, n, k, round(k / n, 8) AS recall, round(greatest(0, {mid} - {half}), 8) AS low, round(least(1, {mid} + {half}), 8) AS high FROM ({g}) y"


def builtin_entities(d) -> str:
    """Counts of token-bounded patterns in normalised text, token by token."""
    words = d.split("lower(coalesce(text, ''))", r"[ \n]+")
    n = lambda p: f"cast({d.size}({d.filter('w', 'x', d.matches('x', p))}) AS BIGINT)"
    return f"SELECT doc_id, {n('^[0-9]+([.][0-9]+)?$')} AS numbers, {n('^[0-9]{7,15}$')} AS phones, {n('^[0-9]+(mg|ml|mcg|g)$')} AS dosages, {n('^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}$')} AS dates FROM (SELECT doc_id, {words} AS w FROM {d.table('documents')}) x"


def keyterm_insertions(d) -> str:
    """Occurrences of key terms in hypotheses beyond those in their references."""
    count = lambda a: f"{d.size}({d.filter(a, 'x', "x IN ('zz', 'the', 'and')")})"
    return f"SELECT sys, cast(sum(greatest({count('hyp')} - {count('toks')}, 0)) AS BIGINT) AS false_insertions, cast(sum({count('hyp')}) AS BIGINT) AS occurrences FROM ({hyps(d)}) h GROUP BY sys"


def normalised(d) -> str:
    """The rules that need no state, in order: markup, o.k., ninth, digits in brackets, ordinals, decimals."""
    s = "coalesce(text, '')"
    for pattern, by in ((r"</?[A-Za-z_]+ ?/?>", " "), (r"\bo\.k\.", "okay"), (r"\bninth\b", "nineth"), (r"\(([0-9]+)\)", " $1 "), (r"\b([0-9]+)(st|nd|rd|th)\b", "$1"), (r"\b(one)\.([0-9])", "1.$2"), (r"[ \n]+", " ")):
        s = d.replace(s, pattern, by)
    return f"SELECT doc_id, md5({s}) AS digest, length({s}) AS n FROM {d.table('documents')}"


#: Rules that need no state: (name, pattern, replacement), in order; what stands in a reference and a hypothesis where a rule matters.
NATIVE_RULES = (("markup", r"</?[A-Za-z_]+ ?/?>", " "), ("okay", r"\bo\.k\.", "okay"), ("ninth", r"\bninth\b", "nineth"), ("paren_digits", r"\(([0-9]+)\)", " $1 "), ("ordinals", r"\b([0-9]+)(st|nd|rd|th)\b", "$1"), ("decimals", r"\b(one)\.([0-9])", "1.$2"))
VARIANTS = (("word", "<b> word"), ("okay", "o.k."), ("nineth", "ninth"), ("12", "(12)"), ("3", "3rd"), ("1.5", "one.5"), ("plain", "plain"))


def _standardised(d, sql: str, columns: tuple[str, ...], off: str = "''") -> str:
    """``sql`` with its text ``columns`` after the rules but the one that ``off`` names, a rule a step, and split into words."""
    for k, (name, pattern, by) in enumerate(NATIVE_RULES):
        steps = ", ".join(f"CASE WHEN {off} = '{name}' THEN {c}{k or ''} ELSE {d.replace(f'{c}{k or ""}', pattern, by)} END AS {c}{k + 1}" for c in columns)
        sql = f"SELECT *, {steps} FROM ({sql}) step{k}"
    words_ = ", ".join(f"{d.filter(d.split(f'{c}{len(NATIVE_RULES)}', ' +'), 'x', "x <> ''")} AS {c}_words" for c in columns)
    return f"SELECT *, {words_} FROM ({sql}) steps"


def _formatted(d) -> str:
    """(utt_id, sys, ref_text, hyp_text): references and hypotheses that also differ in how they write one thing, and now and then in what it is."""
    kind, other = f"{d.hex_int("'kind:' || utt_id", 4)} % 7", f"CASE WHEN {d.hex_int("'swap:' || sys || utt_id", 4)} % 9 = 0 THEN ({d.hex_int("'kind:' || utt_id", 4)} + 1) % 7 ELSE {d.hex_int("'kind:' || utt_id", 4)} % 7 END"
    pick = lambda i, side: "CASE " + i + " " + " ".join(f"WHEN {k} THEN '{v[side]}'" for k, v in enumerate(VARIANTS)) + " END"
    return f"SELECT utt_id, sys, {d.join}(toks, ' ') || ' ' || {pick(kind, 0)} AS ref_text, {d.join}(hyp, ' ') || ' ' || {pick(other, 1)} AS hyp_text FROM ({hyps(d, ('s1', 's2'))}) h"


def _without_each(d, sql: str, columns: tuple[str, ...]) -> str:
    """``sql`` with its text ``columns`` after all rules as <column>_all, and after all but rule k as <column>_<k>. What comes before a rule is done once."""
    sql = f"SELECT *, {', '.join(f'{c} AS {c}_all' for c in columns)} FROM ({sql}) texts"
    kept = "utt_id, sys"
    for k, (_, pattern, by) in enumerate(NATIVE_RULES):
        done = ", ".join(f"{d.replace(f'{c}_{v}', pattern, by)} AS {c}_{v}" for c in columns for v in ("all", *range(k)))
        sql = f"SELECT {kept}, {done}, {', '.join(f'{c}_all AS {c}_{k}' for c in columns)} FROM ({sql}) step{k}"
    return sql


def rule_ablation(d) -> str:
    """Errors without each rule, and the utterances that it helps or hurts: what removing the rule adds is what the rule removes.

    A pair is a row until its distance with all rules is known; then it has a row a rule, whose texts are null where the rule changes neither. Such rows
    take over what the pair has with all rules, and only the others are compared again.
    """
    words = lambda c: d.filter(d.split(c, " +"), "x", "x <> ''")
    differs = lambda k: f"ref_text_{k} <> ref_text_all OR hyp_text_{k} <> hyp_text_all"
    own = [d.struct(rule=f"'{r[0]}'", a=f"CASE WHEN {differs(k)} THEN ref_text_{k} END", b=f"CASE WHEN {differs(k)} THEN hyp_text_{k} END") for k, r in enumerate(NATIVE_RULES)]
    each = d.array(d.struct(rule="'none'", a="cast(NULL AS STRING)", b="cast(NULL AS STRING)"), *own)
    v = f"SELECT sys, {words('ref_text_all')} AS toks, {words('hyp_text_all')} AS hyp, {each} AS rules FROM ({_without_each(d, d.deal(_formatted(d), 'utt_id'), ('ref_text', 'hyp_text'))}) v0"
    whole = f"SELECT sys, cast({d.size}(toks) AS BIGINT) AS n0, {_distance(d, 'toks', 'hyp')} AS e0, rules FROM (SELECT *, {d.distinct}({d.concat_arrays}(toks, hyp)) AS dict FROM ({v}) v1) v2"
    rows = f"SELECT sys, n0, e0, x.rule AS rule, x.a IS NULL AS same, {words('x.a')} AS toks, {words('x.b')} AS hyp FROM (SELECT sys, n0, e0, {d.explode('rules')} AS x FROM ({whole}) w0) w1"
    one = f"SELECT sys, rule, e0, CASE WHEN same THEN n0 ELSE {d.size}(toks) END AS n, CASE WHEN same THEN e0 ELSE {_distance(d, 'toks', 'hyp')} END AS e FROM (SELECT *, CASE WHEN NOT same THEN {d.distinct}({d.concat_arrays}(toks, hyp)) END AS dict FROM ({rows}) x0) x1"
    return f"SELECT rule, sys, cast(sum(e) AS BIGINT) AS errors, cast(sum(n) AS BIGINT) AS n_ref, cast(count_if(e > e0) AS BIGINT) AS helped, cast(count_if(e < e0) AS BIGINT) AS hurt, cast(sum(greatest(e - e0, 0)) AS BIGINT) AS removed, cast(sum(greatest(e0 - e, 0)) AS BIGINT) AS added FROM ({one}) y GROUP BY rule, sys"


def leaderboard_wer(d) -> str:
    """The error rate with the rules beside the one without them."""
    bare = lambda t: d.filter(d.split(t, " +"), "x", "x <> ''")
    v = f"SELECT sys, ref_text_words AS toks, hyp_text_words AS hyp, {bare('ref_text')} AS toks0, {bare('hyp_text')} AS hyp0 FROM ({_standardised(d, _formatted(d), ('ref_text', 'hyp_text'))}) f"
    one = f"SELECT sys, {d.size}(toks) AS n, {_distance(d, 'toks', 'hyp')} AS e, toks0, hyp0, {d.distinct}({d.concat_arrays}(toks0, hyp0)) AS dict0 FROM (SELECT *, {d.distinct}({d.concat_arrays}(toks, hyp)) AS dict FROM ({v}) v0) v1"
    two = f"SELECT sys, n, e, {d.size}(toks) AS n0, {_distance(d, 'toks', 'hyp')} AS e0 FROM (SELECT sys, n, e, toks0 AS toks, hyp0 AS hyp, dict0 AS dict FROM ({one}) v2) v3"
    return f"SELECT sys, round(sum(e) / sum(n), 8) AS wer, round(sum(e0) / sum(n0), 8) AS leaderboard FROM ({two}) v4 GROUP BY sys"


def duplicate_runs(d) -> str:
    return f"SELECT user_id, event_type, count(*) AS n FROM {d.table('events')} GROUP BY user_id, event_type HAVING count(*) > 1"


def file_names(d) -> str:
    return f"SELECT page_id, replace(replace(url, ':', '__'), '/', '_') AS trace_name, lower({d.at(d.split("coalesce(url, '')", '[.]'), '1')}) AS head FROM {d.table('pages')} WHERE url IS NOT NULL"


def date_orders(d) -> str:
    """Month first for tags that are null, bare, or of the five regions that write so; else day first."""
    tag = "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN lang WHEN 2 THEN lang || '-US' WHEN 3 THEN lang || '-GB' WHEN 4 THEN lang || '-latn-ph' ELSE lang || '-419' END"
    region = d.filter(d.split("upper(tag)", "-"), "x, i", f"{d.index} > 0 AND length(x) = 2")
    return f"SELECT doc_id, tag, CASE WHEN tag IS NULL OR {d.size}({region}) = 0 THEN 'mdy' WHEN {d.at(region, '1')} IN ('US', 'PH', 'FM', 'MH', 'PW') THEN 'mdy' ELSE 'dmy' END AS date_order FROM (SELECT doc_id, {tag} AS tag FROM {d.table('documents')}) x"


def _runs(d) -> str:
    """(utt_id, speaker_id, subset, synthetic, exclude_reason, sys, error, hyp_text, n_ref, n_hyp, errors): a manifest beside the rows of three runs.

    A failed row has an error; its hypothesis is empty then, whatever it says."""
    h = lambda name: d.hex_int(f"'{name}:' || utt_id", 4)
    reason = f"CASE {h('reason')} % 29 WHEN 0 THEN 'unintelligible' WHEN 1 THEN 'inaudible' WHEN 2 THEN 'too_short' END"
    failed = f"{d.hex_int("'fail:' || sys || utt_id", 4)} % 31 = 0"
    return f"SELECT utt_id, speaker_id, subset, {h('synth')} % 5 = 0 AS synthetic, {reason} AS exclude_reason, sys, CASE WHEN {failed} THEN 'HTTP 503' END AS error, n_ref, CASE WHEN {failed} THEN 0 ELSE n_hyp END AS n_hyp, CASE WHEN {failed} THEN n_ref ELSE errors END AS errors FROM ({scores(d)}) s WHERE {d.hex_int("'cover:' || sys || utt_id", 4)} % 17 <> 0"


def run_report(d) -> str:
    """Statistics of every run over scorable utterances that all runs cover: real ones apart from synthetic ones, all together and by subset."""
    first = f"SELECT *, row_number() OVER (PARTITION BY utt_id, sys ORDER BY errors) AS nth FROM ({_runs(d)}) r0 WHERE exclude_reason IS NULL"
    r = f"SELECT *, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY utt_id) AS runs FROM ({first}) r1"  # different runs, not rows
    return (
        f"SELECT synthetic, coalesce(subset, 'All') AS grp, sys, count(*) AS n, cast(count_if(error IS NOT NULL) AS BIGINT) AS failed, cast(count_if(n_hyp = 0 AND n_ref > 0) AS BIGINT) AS empty_on_speech, cast(count_if(n_ref > 0) AS BIGINT) AS n_speech, "
        f"round(sum(errors) / nullif(sum(n_ref), 0), 8) AS wer, round(avg(errors / nullif(n_ref, 0)), 8) AS mean_utt_wer FROM ({r}) r1 WHERE runs = 3 GROUP BY GROUPING SETS ((synthetic, sys), (synthetic, subset, sys))"
    )


def run_counters(d) -> str:
    """A run's summary: rows, failures, empty answers, and what it left out of the manifest."""
    rows = f"SELECT sys, count(*) AS n_rows, cast(count_if(error IS NOT NULL) AS BIGINT) AS failed, cast(count_if(error IS NULL AND n_hyp = 0) AS BIGINT) AS suspect_empty FROM ({_runs(d)}) r GROUP BY sys"
    return f"SELECT sys, n_rows, failed, suspect_empty, m.n - n_rows AS missing FROM ({rows}) x CROSS JOIN (SELECT count(*) AS n FROM ({refs(d)}) u) m"


def ablation_coverage(d) -> str:
    """Utterances that an ablation works on: scorable, answered without an error by every run; the others by what they lack."""
    per = f"SELECT utt_id, max(exclude_reason) AS reason, count(*) AS runs, count_if(error IS NOT NULL) AS failed FROM ({_runs(d)}) r GROUP BY utt_id"
    return f"SELECT CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN runs < 3 THEN 'not covered' WHEN failed > 0 THEN 'failed' ELSE 'covered' END AS status, count(*) AS n FROM ({per}) x GROUP BY 1"


def limited_manifest(d) -> str:
    """A limit counts scorable utterances, not rows of the manifest."""
    return f"SELECT DISTINCT utt_id FROM ({_runs(d)}) r WHERE exclude_reason IS NULL ORDER BY utt_id LIMIT 40"


def usable_sessions(d) -> str:
    """Sessions that a latency report reads, those left out, and those whose speaker is unknown, which a report refuses."""
    s = f"SELECT user_id, errors % 3 = 0 AS failed, n_events > 1 AS traced FROM ({sessions(d)}) s0"
    known = f"SELECT c_custkey AS id, c_nationkey AS cluster FROM {d.table('customer')}"
    return f"SELECT CASE WHEN failed THEN 'failed' WHEN NOT traced THEN 'no trace' WHEN cluster IS NULL THEN 'no cluster' ELSE 'usable' END AS status, count(*) AS n, count(DISTINCT cluster) AS clusters FROM ({s}) s LEFT JOIN ({known}) k ON s.user_id = k.id GROUP BY 1"


def prices(d) -> str:
    """Prices a minute, of configs that are billed by the minute or the hour; unverified ones have none."""
    cfg = f"SELECT p_partkey AS config, p_retailprice AS amount, CASE p_partkey % 3 WHEN 0 THEN 'minute' WHEN 1 THEN 'hour' END AS per FROM {d.table('part')}"
    return f"SELECT config, per, round(CASE per WHEN 'minute' THEN amount WHEN 'hour' THEN amount / 60 END, 6) AS per_minute FROM ({cfg}) c"


def unverified_configs(d) -> str:
    """Configs of a registry that nobody has verified, and whether a look-up by id is unique."""
    cfg = f"SELECT s_name AS config_id, s_suppkey % 4 = 0 AS verify FROM {d.table('supplier')}"
    return f"SELECT config_id, count(*) OVER (PARTITION BY config_id) = 1 AS unique_id FROM ({cfg}) c WHERE verify"


def category_signatures(d) -> str:
    """What makes entity categories of different profiles the same: the built-in kind, else the name."""
    c = f"SELECT p_partkey AS profile, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'number' END AS builtin FROM {d.table('part')}"
    return f"SELECT coalesce(builtin, name) AS signature, count(*) AS categories, count(DISTINCT name) AS names FROM ({c}) x GROUP BY 1"


def provider_errors(d) -> str:
    """Each session's first error event as text, 500 characters at most."""
    ev = f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk, props || props || event_type AS raw FROM {d.table('events')} WHERE event_type = 'error'"
    return f"SELECT user_id, substr(raw, 1, 500) AS error FROM ({ev}) e WHERE rk = 1"


def session_settings(d) -> str:
    """Session settings split from the provider's, with defaults, and whether they are valid."""
    k = d.json_int("props", "k")
    settings = f"CASE {k} % 5 WHEN 0 THEN '{{\"chunk_ms\": 50, \"model\": \"m\"}}' WHEN 1 THEN '{{\"finalization\": \"forced\"}}' WHEN 2 THEN '{{\"encoding\": \"opus\"}}' WHEN 3 THEN '{{\"chunk_ms\": 0, \"trailing_silence_ms\": 300}}' ELSE '{{}}' END"
    s = f"SELECT event_id, cast(coalesce({d.json_text('s', 'chunk_ms')}, '20') AS BIGINT) AS chunk_ms, coalesce({d.json_text('s', 'finalization')}, 'natural') AS finalization, cast(coalesce({d.json_text('s', 'trailing_silence_ms')}, '1500') AS BIGINT) AS trailing_silence_ms, coalesce({d.json_text('s', 'encoding')}, 'pcm16') AS encoding, {d.json_text('s', 'model')} AS model FROM (SELECT event_id, {settings} AS s FROM {d.table('events')}) e"
    return f"SELECT *, finalization IN ('natural', 'forced') AND encoding IN ('pcm16', 'mulaw') AND chunk_ms > 0 AND trailing_silence_ms >= 0 AS valid FROM ({s}) x"


def speech_regions(d) -> str:
    """The speech of a clip in samples: the detector's bounds, or the whole clip, within the clip and never empty."""
    b = f"SELECT user_id, clip_ms, coalesce(speech_start_ms, 0) AS a, coalesce(speech_end_ms, clip_ms) AS z, speech_start_ms IS NULL AS whole FROM ({speech_bounds(d)}) s"
    at = "least(clip_ms * 8 - 1, greatest(0, a * 8))"
    return f"SELECT user_id, cast({at} AS BIGINT) AS start_sample, cast(greatest({at} + 1, least(clip_ms * 8, z * 8)) AS BIGINT) AS end_sample, CASE WHEN whole THEN 'whole_clip' ELSE 'vad' END AS basis FROM ({b}) x"


def normalised_once(d) -> str:
    """Each different text is normalised once and joined back to its rows."""
    s = "t"
    for _, pattern, by in NATIVE_RULES:
        s = d.replace(s, pattern, by)
    words_ = f"SELECT t, md5({s}) AS digest FROM (SELECT DISTINCT coalesce(text, '') AS t FROM {d.table('conversations')}) x"
    return f"SELECT conv_id, turn, digest FROM {d.table('conversations')} c JOIN ({words_}) w ON coalesce(c.text, '') = w.t"


def config_pairs(d) -> str:
    """Clean runs beside augmented ones of the same config, and runs that have no counterpart."""
    clean = f"SELECT DISTINCT 'cfg' || (o_custkey % 40) AS config_id FROM {d.table('orders')} WHERE o_orderstatus = 'F'"
    other = f"SELECT DISTINCT 'cfg' || (o_custkey % 50) AS config_id FROM {d.table('orders')} WHERE o_orderstatus = 'P'"
    return f"SELECT coalesce(a.config_id, b.config_id) AS config_id, CASE WHEN a.config_id IS NULL THEN 'no clean run' WHEN b.config_id IS NULL THEN 'no augmented run' ELSE 'paired' END AS status FROM ({clean}) a FULL OUTER JOIN ({other}) b ON a.config_id = b.config_id"


def boost_lists(d) -> str:
    """A profile's terms for boosting: its own list, else its file's different terms in order, else those of all its lexicons."""
    terms = f"SELECT p_partkey % 50 AS profile, p_partkey % 3 AS origin, lower(p_name) AS term FROM {d.table('part')}"
    found = f"SELECT *, min(CASE WHEN profile % 4 = 0 AND origin = 0 THEN 0 WHEN profile % 4 < 2 AND origin = 1 THEN 1 ELSE 2 END) OVER (PARTITION BY profile) AS best, CASE WHEN profile % 4 = 0 AND origin = 0 THEN 0 WHEN profile % 4 < 2 AND origin = 1 THEN 1 ELSE 2 END AS kind FROM ({terms}) t"
    return f"SELECT profile, CASE best WHEN 0 THEN 'profile' WHEN 1 THEN 'file' ELSE 'lexicons' END AS origin, count(DISTINCT term) AS terms, min(term) AS first_term FROM ({found}) f WHERE kind = best GROUP BY profile, best"


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_words(d) -> str:
    """Cardinals below a million in words, and their digits one by one."""
    ones, tens = d.array(*(f"'{w}'" for w in _ONES)), d.array(*(f"'{w}'" for w in _TENS))
    q = lambda a, b: f"cast(floor(({a}) / {b}) AS INT)"
    small = lambda n: f"CASE WHEN {n} < 20 THEN {d.at(ones, f'cast({n} + 1 AS INT)')} ELSE {d.at(tens, f'greatest({q(n, 10)} - 1, 1)')} || CASE WHEN {n} % 10 > 0 THEN ' ' || {d.at(ones, f'cast({n} % 10 + 1 AS INT)')} ELSE '' END END"
    hundreds = lambda n: f"CASE WHEN {n} < 100 THEN {small(f'({n})')} ELSE {d.at(ones, f'{q(n, 100)} % 10 + 1')} || ' hundred' || CASE WHEN {n} % 100 > 0 THEN ' ' || {small(f'(({n}) % 100)')} ELSE '' END END"
    word = f"CASE WHEN n < 1000 THEN {hundreds('n')} ELSE {hundreds(f'{q("n", 1000)}')} || ' thousand' || CASE WHEN n % 1000 > 0 THEN ' ' || {hundreds('(n % 1000)')} ELSE '' END END"
    digits = f"{d.join}({d.transform(d.filter(d.split('cast(n AS VARCHAR(20))', ''), 'x', "x <> ''"), 'x', d.at(ones, 'cast(x AS INT) + 1'))}, ' ')"
    return f"SELECT o_orderkey, n, {word} AS words, {digits} AS digits FROM (SELECT o_orderkey, (o_orderkey * 7919) % 1000000 AS n FROM {d.table('orders')}) x"


def script_check(d) -> str:
    """Expected entities of scripts against tagged ones, as multisets: how many of each category were found and missed."""
    expected = f"SELECT l_orderkey AS utt, l_partkey % 20 AS text, CASE l_linenumber % 2 WHEN 0 THEN 'number' ELSE 'date' END AS category FROM {d.table('lineitem')}"
    tagged = f"SELECT l_orderkey AS utt, l_partkey % 20 AS text, CASE l_linenumber % 2 WHEN 0 THEN 'number' ELSE 'date' END AS category FROM {d.table('lineitem')} WHERE l_suppkey % 7 <> 0"
    nth = lambda sql: f"SELECT *, row_number() OVER (PARTITION BY utt, category, text ORDER BY utt) AS k FROM ({sql}) n0"
    return f"SELECT e.category, count(t.k) AS found, count(*) - count(t.k) AS missed FROM ({nth(expected)}) e LEFT JOIN ({nth(tagged)}) t ON e.utt = t.utt AND e.category = t.category AND e.text = t.text AND e.k = t.k GROUP BY e.category"


def sampled_manifest(d) -> str:
    """Rows of a manifest for a sample: ids of file names, paths below the data's root, no bounds."""
    name = d.extract("url", "([^/]+)/?$", 1)
    return f"SELECT page_id, 'cv:' || {d.replace(name, '[.][^.]*$', '')} AS utt_id, 'clips/' || {name} AS audio_path, cast(NULL AS DOUBLE) AS start_s FROM {d.table('pages')} WHERE url IS NOT NULL"


def raw_messages(d) -> str:
    """Messages as they are kept: JSON objects as such, other texts as texts, and bytes as their number."""
    m = f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN 'text ' || event_type END AS message, CASE WHEN event_id % 3 = 2 THEN length(props) END AS n_bytes FROM {d.table('events')}"
    return f"SELECT event_id, CASE WHEN message IS NULL THEN 'bytes' WHEN substr(message, 1, 1) = '{{' THEN 'json' ELSE 'text' END AS kind, coalesce(message, 'bytes: ' || n_bytes) AS raw FROM ({m}) x"


QUERIES = {
    f.__name__: f
    for f in (
        utt_wer, pooled_wer, group_stats, paired_coverage, exclusions, worst_utterances, changed_utterances, bootstrap_intervals, paired_differences,
        wilson_by_event, degradation, speaker_sample, sample_digest, stratified_round_robin, session_latency, speaker_latency, run_report, run_counters, ablation_coverage,
        limited_manifest, usable_sessions, prices, unverified_configs, category_signatures, provider_errors, session_settings, speech_regions, normalised_once, config_pairs, boost_lists,
        number_words, script_check, sampled_manifest, raw_messages, sweep_points, leaderboard_wer, endpoint_outcomes,
        rate_limit, pacing, speech_segments, speech_bounds, vad_join, transcripts, sent_at, step_seeds, knob_inference, sweep_table, resume_plan,
        boost_terms, entity_recall, builtin_entities, keyterm_insertions, normalised, rule_ablation, duplicate_runs, file_names, date_orders,
    )
}
