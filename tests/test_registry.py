"""The registry holds together, and a few queries agree with their SQL twins on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import norm

DATA = Path("/root/testdata/sf0.001")
SAMPLE = ("p3_found", "p4_found", "p6_found", "g5_list_callers", "a1_aggregate_ids", "x4_contracts", "l8_name_arm", "n4_anchor_fold", "i5_cross_wire_duplicates", "e4_pair_commands", "content_p17_html_classes")


def test_every_twin_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", SAMPLE)
def test_twins_agree(spark, name):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    df = entry.queries()[name](spark, str(DATA))
    assert sorted(cols) == sorted(df.columns)
    want = Counter(tuple(norm(v) for _, v in sorted(zip(cols, r))) for r in rel.fetchall())
    got = Counter(tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect())
    assert got == want


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_flagship(spark):
    assert entry.entry(spark).count() == 20
