"""The driver's contract: the entry query, the registry, and results equal to the oracle SQL."""

import datetime as dt
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SHOWN = "q1_pricing_summary q3_shipping_priority asof_left fuzzy_join win_groups win_exclude_current top_with_ties pivot_dynamic recursive_union_graph tf_fill_dates tf_interpolate_linear compare_datasets match_recognize_pair merge_upsert dq_quarantine fn_string fn_date stream_session lang_asof lang_script".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else str(v) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", SHOWN)
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall()), key=str)


def test_the_rest_imports_without_the_training_data_part(tmp_path):
    root = Path(entry.__file__).parent
    for p in root.rglob("*.py"):
        part = p.relative_to(root)
        if part.parts[0] in ("quarry", "__spark_entry__.py") and "llm" not in part.parts:
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(p.read_text())
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert int(out.stdout) == len(catalog.QUERIES), out.stderr
