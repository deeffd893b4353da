"""The registered queries against DuckDB, and cells and tables of prose."""

from __future__ import annotations

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.functions import cells
from tessella.functions import money as money_cells
from tessella.operators import lists
from tessella.plans import entries, tables
from tessella.sources import pipe_tables

SF = Path("/root/testdata/sf0.001")
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.mark.skipif(not SF.exists(), reason="the tables aren't there")
@pytest.mark.parametrize("name", sorted(tables.QUERIES | entries.QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in NAMES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute((tables.SQL | entries.SQL)[name])
    columns = [c[0] for c in want.description]
    df = (tables.QUERIES | entries.QUERIES)[name](spark, str(SF))
    assert sorted(df.columns) == sorted(columns)
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(want.fetchall())


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("x")).first().x


def test_cells(spark):
    assert [one(spark, x, cells.known) for x in ("—", " Not disclosed ", None, " a ")] == [None, None, None, "a"]
    assert one(spark, " a ; b1 ;; 2 c", cells.many) == ["a", "b1", "2 c"] and one(spark, "—", cells.many) is None
    facts_of = lambda text: [r.fact for r in money_cells.money_facts(spark.createDataFrame([(text,)], "c string"), "c").collect()]
    money = lambda text: [(f.role, f.currency, int(f.lo), None if f.hi == f.lo else int(f.hi)) for f in facts_of(text)]
    assert money("A$1.5m raised (NZ$980k grant); seeking US$2,000,000") == [("raised", "AUD", 1500000, None), ("grant", "NZD", 980000, None), ("sought", "USD", 2000000, None)]
    assert money("A$5m round at A$20m valuation") == [("raised", "AUD", 5000000, None), ("valuation", "AUD", 20000000, None)]
    assert money("Raised US$3m and seeking US$9m") == [("raised", "USD", 3000000, None), ("sought", "USD", 9000000, None)]
    assert money("valuation of £40m seeking £9m") == [("valuation", "GBP", 40000000, None), ("sought", "GBP", 9000000, None)]
    assert money("£1m–£2m revenue") == [("revenue", "GBP", 1000000, 2000000)] and money("A$1-2m turnover") == [("revenue", "AUD", 1000000, 2000000)]
    assert money("€5 months of 2025") == [("raised", "EUR", 5, None)] and money("US$4m raised to 2025, C$7m to date") == [("raised", "USD", 4000000, None), ("raised_to_date", "CAD", 7000000, None)]
    bases = ["A$12m revenue in FY24", "~A$3m revenue year to date", "A$9m cumulative sales since 2021", "forecast revenue A$20m+", "A$2m ARR revenue", "A$6m revenue run rate", "A$6m sales"]
    found = [facts_of(b)[0] for b in bases]
    assert [f.basis for f in found] == ["annual", "ytd", "cumulative", "forecast", "arr", "annualised", "unknown"]
    assert [f.approximate for f in found] == [False, True, False, True, False, False, False] and [f.period for f in found[:3]] == ["FY24", None, "since 2021"]
    assert facts_of("valuation $3m")[0].currency is None and facts_of("Never raised") == [] and facts_of(None) == []
    assert [one(spark, x, cells.status) for x in ("—", "Not disclosed (A$2m grant)", "Bootstrapped — no external round", "A$1m; raising now", "A$1m")] == ["missing", "missing", "none", "raising", "stated"]
    assert one(spark, "Not disclosed; grew 30%", cells.remark) == "grew 30%" and one(spark, "Not disclosed", cells.remark) is None and one(spark, "A$1m", cells.remark) is None
    assert [one(spark, x, cells.known) for x in ("Undisclosed amount", "Undisclosedly", "amount not disclosed in 2024")] == [None, "Undisclosedly", None]
    assert tuple(one(spark, "~10–20 (est.)", cells.number_range)) == (10, 20, True, None) and tuple(one(spark, "1,200", cells.number_range)) == (1200, 1200, False, None)
    assert tuple(one(spark, "8 FTE + casual, latest", cells.number_range)) == (8, 8, False, "FTE + casual, latest")
    assert one(spark, "many", cells.number_range) is None
    assert one(spark, "New (formerly Old, Older)", cells.aliases) == ["Old", "Older"] and one(spark, "New", cells.aliases) == []
    assert tuple(one(spark, "**Shop** (High)", cells.valued)) == ("Shop", "High")


def test_pipe_tables(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\n## One (2)\n| # | Name |\n|--|:-:|\n| 1 | **a** |\n| 2 | — |\n\nprose | with a pipe\n## Two\n| # | Name | Country |\n|---|---|---|\n| 3 | c | NZ |\n| 4 | d |\n")
    rows = [(r.line, r.section, r.cells) for r in pipe_tables.read_pipe_tables(spark, str(tmp_path)).orderBy("line").collect()]
    assert rows == [(6, "One (2)", {"#": "1", "Name": "**a**"}), (7, "One (2)", {"#": "2", "Name": "—"}), (13, "Two", {"#": "3", "Name": "c", "Country": "NZ"}), (14, "Two", {"#": "4", "Name": "d"})]


def test_rule_has_three_values(spark):
    day = datetime.date(2026, 1, 1)
    rows = [(2e6, None, None), (5e5, None, None), (None, 5e6, day), (5e5, 5e7, day), (None, None, None), (5e5, 1e6, datetime.date(2020, 1, 1))]
    df = spark.createDataFrame(rows, "r double, a double, d date")
    rule = lists.qualifies(F.col("r"), 1e6, 1e7, F.col("a"), 1e7, F.col("d"), F.lit(datetime.date(2025, 2, 1)), F.lit(datetime.date(2026, 7, 31)))
    assert [r.q for r in df.select(rule.alias("q")).collect()] == [True, None, True, False, None, False]


def test_ranges_and_caveats(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 9 + [("c",)] * 4 + [("d",)], "g string")
    targets = spark.createDataFrame([("a", 6, 8), ("b", 2, 7), ("c", None, None), ("e", 1, 2)], "g string, lo long, hi long")
    assert sorted(map(tuple, lists.against_ranges(df, "g", targets).collect())) == [("a", 6, 8, 5, -1), ("b", 2, 7, 9, 2), ("c", 2, 10, 4, 0), ("d", None, None, 1, None), ("e", 1, 2, 0, -1)]
    caveats = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x")], "g string, class string")
    assert {r.g: r.caveats for r in lists.with_caveats(df.distinct(), caveats, "g").collect()} == {"a": ["x", "y"], "b": [], "c": [], "d": []}
