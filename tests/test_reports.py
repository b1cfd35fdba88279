"""Reports as Markdown, from small tables with known numbers."""

import math

import pytest

from vocalith.operators.resampling import latency_intervals
from vocalith.operators.traces import session_latency
from vocalith.plans import frames, report


def test_groups_intervals_are_those_of_each_alone(session):
    rows = [(k, i % 7, math.inf if i % 23 == 0 else 10.0 * i + len(k)) for k in ("a", "bb") for i in range(1, 90)]
    df = session.createDataFrame(rows, "k STRING, cluster BIGINT, v DOUBLE")
    both = {r.k: tuple(r)[1:] for r in latency_intervals(df, 60, keys=["k"]).collect()}
    for k in ("a", "bb"):
        assert both[k] == tuple(latency_intervals(df.where(f"k = '{k}'").drop("k"), 60).first())


def test_the_latency_report(session):
    sessions, events = frames._traces(session, "/root/testdata/sf0.001")
    clustered = sessions.selectExpr("file", "finalization_mode", "cast(file AS BIGINT) % 12 AS cluster")
    rows = report.latency_rows(session_latency(sessions, events), clustered, resamples=50)
    text = report.latency(rows)
    assert text.startswith("# Streaming latency\n\nMilliseconds") and "## Provider endpointing (natural)" in text and "## Forced finalization (forced)" in text
    (natural,) = [x for x in text.split("\n") if x.startswith("| c |")][:1]
    cells = natural.strip("| ").split(" | ")
    assert len(cells) == 9 and cells[6].startswith("n/a (not_applicable") and "[" in cells[3] and cells[8].endswith("%")
    assert "speaker clustering effect" in text and ("last_final" in text or "word_timestamps" in text)
    few = report.latency(report.latency_rows(session_latency(sessions, events), clustered.selectExpr("file", "finalization_mode", "cluster % 3 AS cluster"), resamples=20))
    assert "(too few to call)" in few


def test_the_degradation_report(session):
    rows = session.createDataFrame([("b", 0.1, 0.125, 0.025, 0.01, 0.04, 0.25, 0.0123, 40, 1, 20), ("a", 0.1, 0.11, 0.01, -0.002, 0.02, 0.1, 0.2, 40, 0, 20)], "config_id STRING, clean DOUBLE, augmented DOUBLE, difference DOUBLE, low DOUBLE, high DOUBLE, relative DOUBLE, p DOUBLE, parents BIGINT, dropped BIGINT, speakers BIGINT")
    lines = report.degradation(rows, "phone").split("\n")
    assert lines[0] == "# Degradation under `phone`" and lines[4] == "| a | 10.00% | 11.00% | +1.00 pp [-0.20, +2.00] | +10% | 0.2000 | 40 | 20 |"
    assert lines[5] == "| b | 10.00% | 12.50% | +2.50 pp [+1.00, +4.00] | +25% | 0.0123 | 39 | 20 |" and lines[7] == "Utterances not covered by both runs (dropped): b: 1."


def test_the_equivalence_report(session):
    rows = session.createDataFrame([("none", "s", 50, 1000, 0, 0, 0, 0), ("okay", "s", 60, 1000, 12, 2, 13, 3)], "rule STRING, sys STRING, errors BIGINT, n_ref BIGINT, helped BIGINT, hurt BIGINT, removed BIGINT, added BIGINT")
    text = report.equivalence(rows)
    assert "| s | 5.00% |" in text and "| `okay` | s | 6.00% | -1.00 pp | 12 / 2 | 13 / 3 |" in text


def test_a_sweep_has_its_columns_in_order(session, tmp_path):
    one = session.createDataFrame([tuple(str(i) for i in range(len(report.SWEEP)))], ", ".join(f"{c} STRING" for c in reversed(report.SWEEP))).coalesce(1)
    report.write_sweep(one, str(tmp_path / "sweep"))
    (part,) = (tmp_path / "sweep").glob("part-*.csv")
    assert part.read_text().splitlines()[0] == ",".join(report.SWEEP)
    with pytest.raises(ValueError, match="late_low"):
        report.write_sweep(one.drop("late_low"), str(tmp_path / "no"))
