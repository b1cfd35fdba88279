"""Markdown of small aggregates: only tables with a row a system, group or category come to the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.operators.resampling import RESAMPLES, latency_intervals
from vocalith.plans.dialect import Spark
from vocalith.plans.evaluation import QUERIES
from vocalith.sources.files import write_csv


def percent(x: float | None) -> str:
    return "n/a" if x is None or math.isnan(x) else f"{100 * x:.1f}%"


def interval(x: float | None, low: float | None, high: float | None) -> str:
    return percent(x) if low is None or high is None else f"{percent(x)} [{100 * low:.1f}, {100 * high:.1f}]"


def points(x: float | None, low: float | None = None, high: float | None = None, digits: int = 1) -> str:
    if x is None:
        return "n/a"
    ends = "" if low is None or high is None else f" [{100 * low:+.{digits}f}, {100 * high:+.{digits}f}]"
    return f"{100 * x:+.{digits}f} pp{ends}"


def milliseconds(x: float | None) -> str:
    return "n/a" if x is None else "timeout" if math.isinf(x) else f"{x:.0f}"


def table(df: DataFrame, columns: Sequence[tuple[str, Callable[[dict], object]]], order: Sequence[str]) -> str:
    """A table of ``df``'s rows, a heading and a function of the row for each column; bars in cells are escaped."""
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    rows = [r.asDict() for r in df.orderBy(*order).collect()]
    lines = [" | ".join(h for h, _ in columns), "|".join("-" for _ in columns)] + [" | ".join(cell(f(r)) for _, f in columns) for r in rows]
    return "\n".join(f"| {x} |" if x.strip("-|") else f"|{x}|" for x in lines)


def accuracy(spark: SparkSession, sf_dir: str) -> str:
    """The report on accuracy: groups, intervals, pairs of systems, worst utterances."""
    q = lambda name: spark.sql(QUERIES[name](Spark(sf_dir)))
    groups = q("group_stats").join(q("bootstrap_intervals"), "sys", "left")
    wer = lambda r: r["errors"] / r["n_ref"] if r["n_ref"] else None
    whole = lambda r: interval(wer(r), r["low"], r["high"]) if r["grp"] == "All" else percent(wer(r))
    parts = [
        "# Accuracy", table(groups, [("group", lambda r: r["grp"]), ("system", lambda r: r["sys"]), ("utterances", lambda r: r["n"]), ("WER", whole), ("empty on speech", lambda r: f"{r['empty_on_speech']} of {r['n_speech']}")], ["grp", "sys"]),
        "## Pairs", table(q("paired_differences"), [("pair", lambda r: f"{r['sys_a']} / {r['sys_b']}"), ("difference", lambda r: points(r["estimate"], r["low"], r["high"])), ("adjusted p", lambda r: f"{r['holm_p']:.3f}"), ("verdict", lambda r: r["verdict"])], ["sys_a", "sys_b"]),
        "## Worst utterances", table(q("worst_utterances"), [("system", lambda r: r["sys"]), ("utterance", lambda r: r["utt_id"]), ("errors", lambda r: f"{r['errors']} of {r['n_ref']}")], ["sys", "rk"]),
    ]
    return "\n\n".join(parts) + "\n"


#: Metrics of a latency report in order, and speakers below which no config is called better.
METRICS, FEW = ("setup", "first_partial", "ttfs", "finalize", "endpoint"), 10
#: The columns of a sweep's table, in order.
SWEEP = (
    "config_id", "run_id", "knob", "value", "sessions", "unscorable", "premature_rate", "premature_low", "premature_high", "late_rate", "late_low", "late_high",
    "delay_p50_ms", "delay_p50_low", "delay_p50_high", "delay_p95_ms", "delay_p95_low", "delay_p95_high",
)


def latency_rows(metrics: DataFrame, sessions: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """(config_id, finalization_mode, metric, ...): for each config, mode and metric the percentiles with their intervals, what was left out and why, and how
    often the first partial's or final's time is of which kind.

    ``metrics`` are ``traces.session_latency``'s, ``sessions`` (file, finalization_mode, cluster) say what a session is; timeouts count as infinite.
    """
    keys = ["config_id", "finalization_mode", "metric"]
    rows = metrics.join(sessions.select("file", "finalization_mode", "cluster"), "file")
    counted = rows.where(F.col("status").isin("ok", "timeout")).select(*keys, "cluster", F.when(F.col("status") == "ok", F.col("value_ms")).otherwise(float("inf")).alias("v"))
    left = rows.where(~F.col("status").isin("ok", "timeout")).groupBy(*keys, "status").count()
    left = left.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "status", F.col("count").cast("string")))), ", ").alias("excluded"))
    basis = rows.where(F.col("basis").isNotNull()).groupBy(*keys, "basis").count()
    basis = basis.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "basis", F.col("count").cast("string")))), ", ").alias("basis"))
    every = rows.groupBy(*keys).agg(F.count_distinct("file").alias("sessions"), F.count_distinct("cluster").alias("all_speakers"), F.count_distinct(F.when(F.col("premature") > 0, F.col("file"))).alias("early"))
    return every.join(latency_intervals(counted, resamples, keys=keys), keys, "left").join(left, keys, "left").join(basis, keys, "left")


def latency(rows: DataFrame) -> str:
    """The report on latency of ``latency_rows``: a table a mode, a config a row; few speakers make no winner."""

    def cell(r: dict | None) -> str:
        if r is None or not r["n"]:
            return f"n/a ({(r or {}).get('excluded') or 'no sessions'})"
        ends = lambda p: f"{milliseconds(r[f'p{p}'])} [{milliseconds(r[f'low{p}'])}, {milliseconds(r[f'high{p}'])}]"
        late = f" (timeouts {100 * r['timeouts'] / r['n']:.1f}%)" if r["timeouts"] else ""
        return f"{ends(50)} / {ends(95)}{late}"

    by: dict[tuple[str, str], dict[str, dict]] = {}
    for r in rows.collect():  # a row a config, mode and metric
        by.setdefault((r["finalization_mode"], r["config_id"]), {})[r["metric"]] = r.asDict()
    parts = ["# Streaming latency", f"Milliseconds, p50 / p95 with 95% intervals over resampled speakers; timeouts are infinite. Fewer than {FEW} speakers make no winner."]
    for mode, title in (("natural", "Provider endpointing"), ("forced", "Forced finalization")):
        some = sorted(c for m, c in by if m == mode)
        if not some:
            continue
        lines = ["| Config | Sessions | Speakers | " + " | ".join(METRICS) + " | Premature endpoints |", "|" + "---|" * (len(METRICS) + 4)]
        notes = []
        for c in some:
            found = by[mode, c]
            any_ = next(iter(found.values()))
            speakers = f"{any_['all_speakers']}" + (" (too few to call)" if any_["all_speakers"] < FEW else "")
            lines.append(f"| {c} | {any_['sessions']} | {speakers} | " + " | ".join(cell(found.get(m)) for m in METRICS) + f" | {percent(any_['early'] / any_['sessions'])} |")
            t = found.get("ttfs") or {}
            effect = t.get("cluster_effect")
            notes.append(f"- {c}: final words by {t.get('basis') or 'none'}; speaker clustering effect {'-' if effect is None else f'{effect:.2f}'}.")
        parts += [f"## {title} ({mode})", "\n".join(lines), "\n".join(notes)]
    return "\n\n".join(parts) + "\n"


def degradation(rows: DataFrame, recipe: str) -> str:
    """The report on a recipe's degradation, of rows (config_id, clean, augmented, difference, low, high, relative, p, parents, dropped, speakers)."""
    two = lambda x: "n/a" if x is None else f"{100 * x:.2f}%"
    t = table(rows, [
        ("Config", lambda r: r["config_id"]), ("Clean WER", lambda r: two(r["clean"])), ("Augmented WER", lambda r: two(r["augmented"])), ("Difference [95% CI]", lambda r: points(r["difference"], r["low"], r["high"], 2)),
        ("Relative", lambda r: "n/a" if r["relative"] is None else f"{100 * r['relative']:+.0f}%"), ("p", lambda r: f"{r['p']:.4f}"), ("Utts", lambda r: r["parents"] - r["dropped"]), ("Speakers", lambda r: r["speakers"]),
    ], ["difference"])
    lost = [f"{r['config_id']}: {r['dropped']}" for r in rows.where("dropped > 0").orderBy("config_id").collect()]
    return "\n\n".join([f"# Degradation under `{recipe}`", t] + ([f"Utterances not covered by both runs (dropped): {', '.join(lost)}."] if lost else [])) + "\n"


def equivalence(rows: DataFrame) -> str:
    """The report on rules of ``rule_ablation``'s rows (rule, sys, errors, n_ref, helped, hurt, removed, added); rule ``none`` is the full layer."""
    wer = lambda r: r["errors"] / r["n_ref"] if r["n_ref"] else None
    two = lambda x: "n/a" if x is None else f"{100 * x:.2f}%"
    full = {r["sys"]: wer(r) for r in rows.where("rule = 'none'").collect()}
    parts = [
        "# Equivalence layer: per-rule breakdown", table(rows.where("rule = 'none'"), [("Config", lambda r: r["sys"]), ("Full layer", lambda r: two(wer(r)))], ["sys"]),
        table(rows.where("rule <> 'none'"), [
            ("Rule", lambda r: f"`{r['rule']}`"), ("Config", lambda r: r["sys"]), ("WER without", lambda r: two(wer(r))), ("Change from rule", lambda r: "n/a" if None in (full[r["sys"]], wer(r)) else points(full[r["sys"]] - wer(r), digits=2)),
            ("Utts helped / hurt", lambda r: f"{r['helped']} / {r['hurt']}"), ("Errors removed / added", lambda r: f"{r['removed']} / {r['added']}"),
        ], ["rule", "sys"]),
    ]
    return "\n\n".join(parts) + "\n"


def write_sweep(rows: DataFrame, path: str) -> None:
    """A sweep's rows with the fixed columns; one that lacks a column is refused by its name."""
    if lost := [c for c in SWEEP if c not in rows.columns]:
        raise ValueError(f"columns missing: {lost}")
    write_csv(rows, path, SWEEP)
