"""Every query runs; those with SQL give the rows that DuckDB gives."""

import os
import re

import duckdb
import pytest

from lathe.plans import catalog


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, tables, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = tables.sql(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert sorted(repr([plain(r[c]) for c in order]) for r in got) == sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in want.fetchall())


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


#: Queries over all probes: few regular expressions are in the plan of each, as no value is copied to its uses.
PROBES = ["probe_family_counts", "probe_integrity", "probe_neighbourhoods", "probe_stats", "probes_injected"]


@pytest.mark.parametrize("name", PROBES)
def test_probes_are_made_once(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    assert sum(plan.toString().lower().count(f) for f in ("regexp_replace(", "rlike", "regexp_extract(")) < 400
    assert "RepartitionByExpression" in plan.toString()


@pytest.mark.parametrize("name", PROBES)
def test_probes_are_made_in_compiled_steps(spark, sf_dir, name):
    """No projection has most of the regular expressions, none is in a lambda, and none but the scan's is compiled with others into one method."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().lower().splitlines()
    counts = [sum(line.count(f) for f in ("regexp_replace(", "rlike", "regexp_extract(")) for line in plan]
    steps = [line for line, n in zip(plan, counts) if n]
    assert len(steps) > 4 and max(counts) < 60
    assert not any(re.search(r"lambdafunction\([^,]*(regexp_|rlike)", line) for line in steps)
    assert all("lambdafunction(" in line for line in steps)


def test_probes_are_joined_while_rows_are_narrow(spark, sf_dir):
    plan = catalog.QUERIES["probes_injected"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_" not in plan[plan.index("Join LeftOuter") :].lower()


@pytest.mark.parametrize("name", ["probe_neighbourhoods", "probe_stats", "probes_injected"])
def test_probes_take_little_to_plan_and_put_together(spark, sf_dir, name, monkeypatch):
    """Patterns take a row's words, one for a list; probes are put together by compiled code; a second query makes no step's columns again."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().lower()
    assert sum(plan.count(f) for f in ("regexp_replace(", "rlike", "regexp_extract(")) < 80
    assert not any("lambdafunction(" in line for line in plan.splitlines() if "probe_id" in line or "- generate " in line)
    monkeypatch.setattr("lathe.functions.probes._neighbourhood", lambda *_: pytest.fail("made again"))
    catalog.QUERIES[name](spark, sf_dir)
