"""Every registered query with check SQL, against DuckDB, on the smallest data."""

import subprocess
import sys
from pathlib import Path

import pytest
from compare import check, duck
from conftest import SF

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert check(con, ORACLES[name], QUERIES[name](spark, SF)) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).collect()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"group_id", "tier", "members", "reclaimable", "keeper_reason"} <= set(rows[0].asDict())
    assert [(r.tier, -r.reclaimable, r.group_id) for r in rows] == sorted((r.tier, -r.reclaimable, r.group_id) for r in rows)


def test_workers_need_no_copy_of_the_package():
    script = Path(__file__).resolve().parent / "elsewhere.py"
    done = subprocess.run([sys.executable, str(script), "emb3", "fpr8"], cwd="/", capture_output=True, text=True, timeout=300)
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("@")] == ["emb3", "fpr8"]
