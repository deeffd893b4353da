"""Cells of prose, names, rules, history, provenance and claims, in the shapes that lists have, with invented figures."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tessella.functions import cells, intervals, money, parts, periods
from tessella.operators import claims, history, lists, names, provenance, qualify, rules
from tessella.sources import pipe_tables

RATES = {"AUD": 0.5, "NZD": 0.5, "USD": 1.0, "GBP": 1.3}
day = datetime.date


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", column(F.col("c")).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


def facts(spark, text, role):
    rows = money.money_facts(spark.createDataFrame([(1, text)], "i int, c string"), "c", role, RATES).collect()
    return [r.fact for r in sorted(rows, key=lambda r: r.fact.place)]


def test_periods(spark):
    want = {
        "14 Jul 2026": (day(2026, 7, 14), day(2026, 7, 14)), "completed Apr 2026": (day(2026, 4, 1), day(2026, 4, 30)), "Jun–Jul 2026": (day(2026, 6, 1), day(2026, 7, 31)), "Nov–Feb 2026": (day(2025, 11, 1), day(2026, 2, 28)), "(2025–26)": (day(2025, 1, 1), day(2026, 12, 31)),
        "FY26": (day(2025, 7, 1), day(2026, 6, 30)), "10mo FY26": (day(2025, 7, 1), day(2026, 4, 30)), "FY2024": (day(2023, 7, 1), day(2024, 6, 30)), "Q1 2024": (day(2024, 1, 1), day(2024, 3, 31)), "H2 2024": (day(2024, 7, 1), day(2024, 12, 31)), "since 2021": (day(2021, 1, 1), None), "Fast 100 2025": (day(2025, 1, 1), day(2025, 12, 31)),
        "Feb 2024": (day(2024, 2, 1), day(2024, 2, 29)), "31 Feb 2026": None, "0 Jan 2026": None, "14mo FY26": None, "2026–24": None, "A$2019.5": None, "12,2019": None, "": None, None: None,
    }
    found = values(spark, list(want), periods.period)
    assert [x and tuple(x) for x in found] == list(want.values())
    calendar = values(spark, ["FY26", "3 months of FY26"], lambda c: periods.period(c, 1))
    assert [tuple(x) for x in calendar] == [(day(2026, 1, 1), day(2026, 12, 31)), (day(2026, 1, 1), day(2026, 3, 31))]


def test_intervals_have_three_answers(spark):
    rows = [(1, 2), (2, 5), (0, 9), (6, 7), (None, 3), (3, None), (None, None), (9, None), (None, 0), (4, 4)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, lo int, hi int")
    found = df.select("i", intervals.inside(F.col("lo"), F.col("hi"), F.lit(2), F.lit(5)).alias("x"), intervals.below(F.col("lo"), F.col("hi"), F.lit(4)).alias("b")).orderBy("i").collect()
    assert [r.x for r in found] == [None, True, None, False, None, None, None, False, False, True]
    assert [r.b for r in found] == [True, None, None, False, True, None, None, False, True, False]
    many = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("b", None), ("c", False), ("d", None)], "k string, v boolean").groupBy("k").agg(intervals.any_of(F.col("v")).alias("v"))
    assert dict(map(tuple, many.collect())) == {"a": True, "b": None, "c": False, "d": None}


#: (role, basis, currency, lo, hi, period) of each amount in a revenue cell.
REVENUE = {
    "~A$3.1M FY26": [("revenue", "annual", "AUD", 3.1e6, 3.1e6, "FY26")],
    "~A$210k (early)": [("revenue", "unknown", "AUD", 2.1e5, 2.1e5, None)],
    "~A$3M YTD FY26 (A$8.4M lifetime)": [("revenue", "ytd", "AUD", 3e6, 3e6, "FY26"), ("revenue", "cumulative", "AUD", 8.4e6, 8.4e6, None)],
    "A$610k (10mo FY26); A$520k FY25": [("revenue", "ytd", "AUD", 6.1e5, 6.1e5, "10mo FY26"), ("revenue", "annual", "AUD", 5.2e5, 5.2e5, "FY25")],
    "A$2.5M+ cumulative; >A$1M ARR": [("revenue", "cumulative", "AUD", 2.5e6, None, None), ("revenue", "arr", "AUD", 1e6, None, None)],
    "~A$5M forecast FY26 (A$2.4M prior)": [("revenue", "forecast", "AUD", 5e6, 5e6, "FY26"), ("revenue", "annual", "AUD", 2.4e6, 2.4e6, None)],
    "~A$9.1M annualised": [("revenue", "annualised", "AUD", 9.1e6, 9.1e6, None)],
    "Seven figures within 5 months of launch": [("revenue", "cumulative", None, 1e6, 9999999, None)],
    ">A$1M cumulative (<3 yrs)": [("revenue", "cumulative", "AUD", 1e6, None, None)],
    ">A$2M turnover within 18 months": [("revenue", "cumulative", "AUD", 2e6, None, None)],
    "~A$6M cumulative since 2021": [("revenue", "cumulative", "AUD", 6e6, 6e6, "since 2021")],
    "~A$1–3M (est.; Fast 100 #39)": [("revenue", "unknown", "AUD", 1e6, 3e6, None)],
    "Reported ~A$20M projection": [("revenue", "forecast", "AUD", 2e7, 2e7, None)],
    "Tracking ~A$30M": [("revenue", "forecast", "AUD", 3e7, 3e7, None)],
    "Not disclosed (10x growth over 2 yrs)": [],
    "Monthly revenue more than doubled in 5 months": [],
}
FUNDING = {
    "A$1.3M equity CSF (OnMarket), Jul 2026, $15.5M pre-money": [("raised", "AUD", 1.3e6, 1.3e6, "Jul 2026"), ("valuation", None, 1.55e7, 1.55e7, "Jul 2026")],
    "A$540k equity CSF (OnMarket), completed Apr 2026": [("raised", "AUD", 5.4e5, 5.4e5, "Apr 2026")],
    "A$3M+ Seed, Nov 2025": [("raised", "AUD", 3e6, None, "Nov 2025")],
    ">A$1M raised to date (VC + angels); active raise 2026": [("raised_to_date", "AUD", 1e6, None, None)],
    "A$1M round closed; second ~A$2M round underway (2025–26)": [("raised", "AUD", 1e6, 1e6, None), ("sought", "AUD", 2e6, 2e6, "2025–26")],
    "A$1.5M equity CSF (OnMarket), Jul 2026, 600 investors; ~A$5.1M raised to date": [("raised", "AUD", 1.5e6, 1.5e6, "Jul 2026"), ("raised_to_date", "AUD", 5.1e6, 5.1e6, None)],
    "Up to A$1M equity CSF (Birchal), Dec 2025": [("raised", "AUD", None, 1e6, "Dec 2025")],
    "A$446k State grant (2023); **no external equity yet — actively considering a raise**": [("grant", "AUD", 4.46e5, 4.46e5, "2023")],
    "**Actively seeking NZ$4M** at ~NZ$8.1M valuation, Jun–Jul 2026": [("sought", "NZD", 4e6, 4e6, "Jun–Jul 2026"), ("valuation", "NZD", 8.1e6, 8.1e6, "Jun–Jul 2026")],
    "**Raising up to NZ$2M**, Jul 2026 (Snowball); NZ$1.5M raised previously": [("sought", "NZD", None, 2e6, "Jul 2026"), ("raised", "NZD", 1.5e6, 1.5e6, None)],
    "Raised via Snowball (prior round up to NZ$3M)": [("raised", "NZD", None, 3e6, None)],
    "**£60k pre-seed**, Feb 2026 (The Den — A. Judge & B. Judge, 20%)": [("raised", "GBP", 6e4, 6e4, "Feb 2026")],
    "**US$5M at a $50M valuation**, Apr 2026": [("raised", "USD", 5e6, 5e6, "Apr 2026"), ("valuation", None, 5e7, 5e7, "Apr 2026")],
    "**US$4M Seed**, Jul 2025 (500 Fund, Agri) + A$2.1M State grant": [("raised", "USD", 4e6, 4e6, "Jul 2025"), ("grant", "AUD", 2.1e6, 2.1e6, "Jul 2025")],
    "**£1.4M Series A open**, Jul 2026": [("sought", "GBP", 1.4e6, 1.4e6, "Jul 2026")],
    "Near-seven-figure Seed, Dec 2025": [("raised", None, 1e5, 1e6, "Dec 2025")],
    "Minority stake sold to **A Fund**, 2025": [],
    "Bootstrapped — no external round": [],
}


@pytest.mark.parametrize("text", REVENUE)
def test_revenue_cells(spark, text):
    number = lambda x: None if x is None else float(x)
    assert [(f.role, f.basis, f.currency, number(f.lo), number(f.hi), f.period) for f in facts(spark, text, "revenue")] == REVENUE[text]


@pytest.mark.parametrize("text", FUNDING)
def test_funding_cells(spark, text):
    number = lambda x: None if x is None else float(x)
    assert [(f.role, f.currency, number(f.lo), number(f.hi), f.period) for f in facts(spark, text, "raised")] == FUNDING[text]


def test_one_round_in_two_currencies(spark):
    restated = lambda text: [f.restates for f in facts(spark, text, "raised")]
    assert restated("**US$22M / £17M Series A**, Jul 2026") == [False, True] and restated("US$22M / £5M") == [False, False]
    assert restated("US$22M (≈£17M) Series A") == [False, True] and restated("US$22M / €20M") == [False, None] and restated("US$2M / US$2M") == [False, False]
    assert restated("US$2M seed, £1.5M grant") == [False, False]
    without = money.money_facts(spark.createDataFrame([("US$22M / £17M",)], "c string"), "c").collect()
    assert sorted((r.fact.place, r.fact.restates) for r in without) == [(1, False), (2, None)]


def test_facts_keep_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "A$1M; A$2M", "f", 1), (2, None, "f", 1), (3, "", "f", 1), (4, "—", "f", 1), (1, "A$1M; A$2M", "f", 1)], "_place int, cell string, fact string, _row int")
    out = money.money_facts(df, "cell")
    assert out.columns == ["_place", "cell", "_row", "fact"] and sorted((r._place, r._row, float(r.fact.lo)) for r in out.collect()) == [(1, 1, 1e6)] * 2 + [(1, 1, 2e6)] * 2
    assert money.money_facts(df.limit(0), "cell").count() == 0
    plan = money.money_facts(df, "cell")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_open_rounds(spark):
    raising = [">A$1M raised to date; active raise 2026", "second ~A$1M round underway (2025–26)", "**Actively raising seed**", "no external equity yet — actively considering a raise", "**Actively seeking NZ$4M**", "None yet — founders state they are **open to investment**", "**Opened to outside investment Jan 2026**", "**Raising NZ$3M**, Jul 2026", "**£1.5M Series A open**, Jul 2026"]
    other = {"Raised via Snowball": "stated", "Zero external funding": "none", "Never raised": "none", "A$1M round closed": "stated", "Not disclosed": "missing", "amount not confirmed": "missing", "Opened a store": "stated", None: "missing"}
    assert values(spark, raising, cells.status) == ["raising"] * len(raising) and values(spark, list(other), cells.status) == list(other.values())


def test_rule_from_cells(spark):
    rows = [
        (1, "A$4M FY26", "Not disclosed"), (2, "A$1M FY26", "A$2M Seed, Jul 2026"), (3, ">A$1M ARR", "Never raised"), (4, "A$1M FY26", "Never raised"), (5, "A$9M cumulative", "Not disclosed"), (6, "Not disclosed", "A$2M Seed, 2024–25"), (7, None, None), (8, "A$1M FY26", "Raising A$2M, Jul 2026"),
        (9, "Not disclosed", "US$30M Series A, Jul 2026"), (10, "A$1M FY25; A$4M FY26", "A$1M grant, Jul 2026"), (11, "A$1M FY26", "€1M Seed, Jul 2026"), (12, "A$1M FY26", "US$9.5M / £17M Series A, Jul 2026"), (13, "A$5–30M FY26", "Up to US$9M Seed, Jul 2026"), (None, "A$4M FY26", "—"), (14, "A$1M FY26", "A$2M Seed, Jul 2020"), (14, "A$4M FY26", "—"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k int, revenue string, funding string, key int")
    out = {r.k: (r.revenue_in_band, r.round_in_window, r.qualifies) for r in qualify.qualify(df, "k", "revenue", "funding", RATES, (1e6, 1e7), 1e7, "2025-02-01", "2026-07-31", 5e6).collect()}
    assert out == {
        1: (True, None, True), 2: (False, True, True), 3: (None, False, None), 4: (False, False, False), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None), 8: (False, None, None), 9: (None, False, None), 10: (True, None, True), 11: (False, None, None), 12: (False, True, True), 13: (None, True, True), None: (True, None, True), 14: (True, False, True),
    }
    assert qualify.qualify(df.limit(0), "k", "revenue", "funding", RATES, (1e6, 1e7), 1e7, "2025-02-01", "2026-07-31", 5e6).count() == 0


def test_people(spark):
    want = {
        "Ann Bo, Cy Dee": [("Ann Bo", None, None), ("Cy Dee", None, None)], "Ann Bo (co-founder)": [("Ann Bo", "co-founder", None)], "Ann Bo + co-founders": [("Ann Bo", None, None), (None, "co-founders", None)], "Ann Bo (The Bare Baker) + partner": [("Ann Bo", None, "The Bare Baker"), (None, "partner", None)],
        "Ann & Cy (founders)": [("Ann", "founder", None), ("Cy", "founder", None)], "Ann Bo (founder); Cy Dee (CEO)": [("Ann Bo", "founder", None), ("Cy Dee", "ceo", None)], "Founder of Old Jam": [(None, "founder", "Old Jam")], 'Prof. Ann-Lee "Al" Bo': [('Prof. Ann-Lee "Al" Bo', None, None)],
        "Ann (CEO, founder), Cy (of A, B & C)": [("Ann", "ceo, founder", None), ("Cy", None, "of A, B & C")], "—": None, None: None,
    }
    assert [x and [tuple(p) for p in x] for x in values(spark, list(want), parts.people)] == list(want.values())


def test_other_names(spark):
    want = {
        "New (formerly Old)": ("New", [("former", "Old")]), "York Brands (one Skin, TWO LAB, Three&Four)": ("York Brands", [("brand", "one Skin"), ("brand", "TWO LAB"), ("brand", "Three&Four")]), "ZERO (by My Kid)": ("ZERO", [("maker", "My Kid")]), "One / Two Foods": ("One", [("other", "Two Foods")]),
        "Hill Co. (Little Bird)": ("Hill Co.", [("brand", "Little Bird")]), "Plain": ("Plain", []), "X (brands: A; B)": ("X", [("brand", "A"), ("brand", "B")]), "Open (never closed": ("Open (never closed", []), "—": (None, None), None: (None, None),
    }
    assert values(spark, list(want), parts.main_name) == [m for m, _ in want.values()]
    assert [x and [tuple(p) for p in x] for x in values(spark, list(want), parts.other_names)] == [o and o or o for _, o in want.values()]


def test_sources_and_counts(spark):
    found = values(spark, ["Daily News 14 Jul 2026; Offer page; Food & Drink Apr 2026; Fast 100 2025", "—"], parts.sources)
    assert [tuple(s) for s in found[0]] == [("Daily News", "14 Jul 2026", day(2026, 7, 14), day(2026, 7, 14)), ("Offer page", None, None, None), ("Food & Drink", "Apr 2026", day(2026, 4, 1), day(2026, 4, 30)), ("Fast 100", "2025", day(2025, 1, 1), day(2025, 12, 31))] and found[1] is None
    counts = {"16 FTE + ~60 casual": [(16, 16, False, "FTE"), (60, 60, True, "casual")], "~10–20 (est.)": [(10, 20, True, None)], "1,200": [(1200, 1200, False, None)], "200+": [(200, None, False, None)], "200+ staff, 3 interns": [(200, None, False, "staff"), (3, 3, False, "interns")], "many": [], "—": None}
    assert [x and [tuple(c) for c in x] or x for x in values(spark, list(counts), parts.head_counts)] == list(counts.values())


def test_names_in_prose(spark):
    entries = spark.createDataFrame([(1, "Reef Distilling Co. (Little Bird)"), (2, "Évi Skincare"), (3, "Seed & Sprout"), (4, "Elm Lab"), (5, "Healthy Skin Lab"), (6, "Twin"), (7, "Twin Ltd"), (8, "Now (formerly Then)"), (None, "Nobody"), (9, None)], "k int, name string")
    text = "**Above the cap** (Reef, Evi at C$20M, Seed & Sprout, healthy skin lab, Twin, Then, little bird, Nobody, and arguably Elm Lab and Ghost Foods) — kept"
    mentions = names.listed(spark.createDataFrame([(1, text), (2, "Elm Lab and Évi"), (3, None)], "p int, t string"), "t")
    found = {(r.p, r.mention): (r.k, r.verdict, r.matches) for r in names.resolve(mentions, "mention", entries, "k", "name").collect()}
    one = lambda k: (k, "resolved", 1)
    assert found == {(1, "Reef"): one(1), (1, "Evi"): one(2), (1, "Seed & Sprout"): one(3), (1, "healthy skin lab"): one(5), (1, "Twin"): (None, "ambiguous", 2), (1, "Then"): one(8), (1, "little bird"): one(1), (1, "Nobody"): (None, "unmatched", 0), (1, "Elm Lab"): one(4), (1, "Ghost Foods"): (None, "unmatched", 0), (2, "Elm Lab"): one(4), (2, "Évi"): one(2)}
    odd = spark.createDataFrame([(None,), ("",), ("( )",), ("Lab",), ("The new Elm Lab shop",)], "mention string")
    assert sorted((str(r.mention), r.k, r.verdict) for r in names.resolve(odd, "mention", entries, "k", "name").collect()) == [("", None, "unmatched"), ("( )", None, "unmatched"), ("Lab", None, "unmatched"), ("None", None, "unmatched"), ("The new Elm Lab shop", 4, "resolved")]
    assert sorted(map(tuple, names.repeated_names(entries, "k", "name").collect())) == [(6, "twin", 2), (7, "twin", 2)]
    assert names.resolve(odd, "mention", entries.limit(0), "k", "name").where("verdict <> 'unmatched'").count() == 0


def test_rules(spark):
    df = spark.createDataFrame([(1, "High", "Daily 14 Jul 2026"), (2, "High", "Daily"), (3, "High", None), (4, "Low", "Daily"), (5, None, None), (None, "High", "Daily"), (2, "High", "Daily")], "k int, level string, s string")
    found = rules.violations(df, "k", {"dated": (F.col("level") == "High", rules.dated(F.col("s"))), "recent": (F.col("level") == "High", rules.dated(F.col("s"), F.lit("2027-01-01").cast("date")))})
    both = lambda k, v: [(k, "dated", v), (k, "recent", v)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "recent", "violated"), *both(2, "violated") * 2, *both(3, "undecided"), *both(None, "violated")], key=str)


def test_history(spark):
    t = [day(2026, m, 1) for m in (1, 4, 7, 10)]
    rows = [(t[0], "a", 1, "x"), (t[1], "a", 1, "x"), (t[2], "a", 1, "y"), (t[3], "a", 1, "y"), (t[0], "b", 1, "x"), (t[2], "b", 1, "x"), (t[1], "c", 1, None), (t[2], "c", 1, None), (t[1], "d", 1, "p"), (t[1], "d", 2, "q"), (t[2], "d", 1, "q"), (None, "a", 1, "x"), (t[0], None, 1, "x"), (t[3], "e", 1, "x"), (t[3], "e", 1, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "as_of date, k string, page int, v string, valid_to int")
    found = sorted((tuple(r) for r in history.validity(df, "k", "as_of", ["v"], F.col("page")).collect()), key=str)
    assert found == sorted([("a", "x", t[0], t[2], "changed", False), ("a", "y", t[2], None, None, False), ("b", "x", t[0], t[1], "vanished", False), ("b", "x", t[2], t[3], "vanished", False), ("c", None, t[1], t[3], "vanished", False), ("d", "q", t[1], t[3], "vanished", True), ("e", "x", t[3], None, None, False)], key=str)
    feed = sorted((tuple(r) for r in history.changes(df, "k", "as_of", ["v"], F.col("page")).collect()), key=str)
    assert feed == sorted([(t[1], "b", "removed", None), (t[1], "c", "added", None), (t[1], "d", "added", None), (t[2], "a", "changed", ["v"]), (t[2], "b", "added", None), (t[3], "b", "removed", None), (t[3], "c", "removed", None), (t[3], "d", "removed", None), (t[3], "e", "added", None)], key=str)
    assert history.validity(df.limit(0), "k", "as_of", ["v"]).count() == 0 == history.changes(df.limit(0), "k", "as_of", ["v"]).count()
    assert {r.v for r in history.validity(df.where("k = 'd' and page < 3"), "k", "as_of", ["v"]).collect()} == {"q"}  # without an order the largest


def test_merge_and_refresh(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x"), (None, 1, "n")], "k string, n int, v string")
    changed = spark.createDataFrame([("a", 2, "y"), ("a", 2, "z"), ("b", 4, "old"), ("c", None, "new"), ("a", 1, "w")], "k string, n int, v string")
    assert sorted(map(tuple, history.merge(base, changed, "k", "n").collect()), key=str) == sorted([("a", 2, "z"), ("b", 5, "x"), ("c", None, "new"), (None, 1, "n")], key=str)
    assert sorted(map(tuple, lists.refresh(base, changed, "k").collect()), key=str) == sorted([("a", 2, "z"), ("b", 4, "old"), ("c", None, "new"), (None, 1, "n")], key=str)


def test_enrichment(spark):
    base = spark.createDataFrame([(1, "own", "Low", None, None), (2, None, None, None, None), (3, None, None, 1.5, "High"), (None, None, None, None, None), (2, None, None, None, None)], "k int, mail string, mail_conf string, size double, size_conf string")
    found = spark.createDataFrame([(1, "mail", "m1", "p", "High"), (2, "mail", "m2", "q", "Med"), (2, "mail", "m3", "p", "Med"), (2, "mail", "m4", "a", "Low"), (2, "size", "7", "a", "Guess"), (3, "mail", "m5", "a", "Low"), (3, "mail", None, "a", "High"), (None, "mail", "m6", "a", "High"), (2, "size", "8", "a", "Low"), (2, "other", "9", "a", "High")], "k int, column string, value string, source string, confidence string")
    out = provenance.enrich(base, "k", {"mail": "mail_conf", "size": "size_conf"}, found)
    assert out.columns == ["k", "mail_conf", "size_conf", "mail", "mail_source", "mail_confidence", "size", "size_source", "size_confidence"]
    two = (2, "m3", "p", "Med", 8.0, "a", "Low")
    assert sorted((tuple(r) for r in out.drop("mail_conf", "size_conf").collect()), key=str) == sorted([(1, "own", "list", "Low", None, None, None), two, two, (3, "m5", "a", "Low", 1.5, "list", "High"), (None, None, None, None, None, None, None)], key=str)
    sure = {r.k: r.mail for r in provenance.enrich(base, "k", {"mail": "mail_conf"}, found, least="Med").collect()}
    assert sure == {1: "own", 2: "m3", 3: None, None: None}


def test_claims(spark):
    want = {
        "## Section 1 — Australia (46 companies)": [("companies", 46, 46, False)], "**100 direct-to-consumer brands** selling": [("brands", 100, 100, False)], "Roughly 30 companies have a figure": [("companies", 30, 30, True)], "**Twelve entries carry** a note": [("entries", 12, 12, False)],
        "rows 94–99 and the three over-cap entries, which leaves 91 companies": [("entries", 3, 3, False), ("companies", 91, 91, False)], "10–15 companies, at least 8 brands, up to five entries": [("companies", 10, 15, False), ("brands", 8, None, False), ("entries", None, 5, False)], "1,200 companies and twenty-one brands": [("companies", 1200, 1200, False), ("brands", 21, 21, False)],
        "US$30 companies, #5 brands, 3.5 entries, 20% companies": [], "2025 was the year": [], None: [],
    }
    df = spark.createDataFrame(list(enumerate(want)), "i int, t string")
    out: dict[int, list] = {i: [] for i in range(len(want))}
    for r in claims.claims(df, "t", ("companies", "brands", "entries")).orderBy("i", "claim.place").collect():
        out[r.i].append((r.claim.thing, r.claim.lo, r.claim.hi, r.claim.approximate))
    assert list(out.values()) == list(want.values())
    stated = claims.claims(spark.createDataFrame([("a", "46 companies"), ("b", "roughly 30 companies"), ("c", "5 companies"), ("d", "2 companies"), (None, "2 companies")], "s string, t string"), "t", ("companies",))
    counted = spark.createDataFrame([("a", 46), ("b", 32), ("c", 6), ("e", 1), (None, 2)], "s string, counted int")
    found = sorted(((r.s, r.verdict) for r in claims.reconcile(stated, counted, ["s"]).collect()), key=str)
    assert found == sorted([("a", "agrees"), ("b", "agrees"), ("c", "differs"), ("d", "uncounted"), ("e", "unstated"), (None, "uncounted"), (None, "unstated")], key=str)


def test_conversion_and_clashing_names(spark):
    df = spark.createDataFrame([("AUD", 2.0, 1), ("EUR", 3.0, 2), (None, 4.0, 3), ("AUD", None, 4)], "currency string, amount double, _rate int")
    rates = spark.createDataFrame([("AUD", 0.4), ("AUD", 0.5), (None, 9.0)], "currency string, rate double")
    assert sorted((r._rate, r.usd) for r in lists.convert(df, "amount", "currency", rates, "usd").collect()) == [(1, 1.0), (2, None), (3, None), (4, None)]


def test_repeated_headers(spark):
    df = spark.createDataFrame([("p", "| A | A | B |\n|---|---|---|\n| 1 | 2 | 3 |"), ("q", None)], "path string, text string")
    assert [r.cells for r in pipe_tables.parse_pipe_tables(df).collect()] == [{"A": "1", "A 2": "2", "B": "3"}]


def test_the_rule_reads_each_different_cell_once(spark, monkeypatch):
    read, facts = [], qualify.money.money_facts

    def counted(df, *rest):
        read.append(df.count())
        return facts(df, *rest)

    monkeypatch.setattr(qualify.money, "money_facts", counted)
    rows = [(k, ("A$900k FY25", None, "")[k % 3], ("Bootstrapped", "A$2M seed, Jul 2025", None)[k % 3]) for k in range(60)]
    found = qualify.qualify(spark.createDataFrame(rows, "k long, r string, f string"), "k", "r", "f", {"AUD": 1.0}, (5e5, 5e6), 5e6, "2025-01-01", "2026-12-31", 1e6).collect()
    assert max(read) <= 2
    assert {r.k: tuple(r)[1:] for r in found} == {k: ((True, False, True, True), (None, True, True, None), (None, None, None, None))[k % 3] for k in range(60)}
