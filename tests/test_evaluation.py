"""Expected values of the statistics, and both dialects' agreement where the driver's tables are at hand."""

import math
import os

import pytest

from vocalith.plans import frames
from vocalith.plans.dialect import Duck, Spark
from vocalith.plans.evaluation import QUERIES

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "none"
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def compare(df, sql):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    rel = c.sql(sql)
    ours, theirs = df.collect(), rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(x) for x in df.columns]
    assert sorted(tuple(map(cell, r)) for r in ours) == sorted(tuple(cell(r[i]) for i in order) for r in theirs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", QUERIES)
def test_dialects_agree(session, name):
    compare(session.sql(QUERIES[name](Spark(SF))), QUERIES[name](Duck()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", frames.QUERIES)
def test_frames_agree(session, name):
    df = frames.QUERIES[name](session, SF)
    if name in frames.ORACLE:
        compare(df, frames.ORACLE[name])
    else:
        assert df.count() > 0


def test_what_is_computed_once_follows_its_files(session, tmp_path):
    import pandas as pd

    from vocalith.plans.dialect import Spark

    def asked():
        d = Spark(str(tmp_path), session)
        return session.sql(d.once("few", f"SELECT sum(x) AS s FROM {d.table('t')}")).first().s

    pd.DataFrame({"x": [1, 2]}).to_parquet(tmp_path / "t.parquet")
    assert asked() == 3 and asked() == 3
    views = [t.name for t in session.catalog.listTables(pattern="few_*")]
    pd.DataFrame({"x": [1, 2, 40]}).to_parquet(tmp_path / "t.parquet")
    assert asked() == 43
    assert len(views) == 1 and len([t for t in session.catalog.listTables(pattern="few_*")]) == 1
