"""Registered queries over cells of prose, in the shapes that lists of companies have, made from the star schema's numbers; and their SQL.

Each shape is a template of text beside what it says, as SQL over the same numbers: a (100 to 999), b (10 to 99) and y
(two digits of a year).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import cells, money, parts
from tessella.operators import claims, history, names, provenance, qualify, rules

RATES = {"AUD": 0.65, "NZD": 0.60, "USD": 1.0, "GBP": 1.3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filled(template: str, numbers: dict[str, Column]) -> Column:
    """The template with its {a}, {b}, ... replaced by numbers, as text."""
    out, rest = [], template
    while rest:
        text, mark, rest = rest.partition("{")
        out.append(F.lit(text))
        if mark:
            name, _, rest = rest.partition("}")
            out.append(numbers[name].cast("string"))
    return F.concat(*out)


def _chosen(templates: list[str], by: Column, numbers: dict[str, Column]) -> Column:
    return reduce(lambda c, i: c.when(by == i, _filled(templates[i], numbers)), range(1, len(templates)), F.when(by == 0, _filled(templates[0], numbers)))


def _numbers() -> dict[str, Column]:
    return {"a": F.col("o_custkey") % 900 + 100, "b": F.col("o_orderkey") % 90 + 10, "y": F.col("o_orderkey") % 6 + 20, "z": F.col("o_orderkey") % 6 + 21}


_SQL_NUMBERS = "SELECT o_orderkey, o_custkey % 900 + 100 AS a, o_orderkey % 90 + 10 AS b, (o_orderkey % 6 + 2020)::INT AS y FROM orders"


def _days(first: str, last: str) -> str:
    return f"make_date({first}, 1), last_day(make_date({last}, 1))"


_FISCAL, _NONE = _days("y - 1, 7", "y, 6"), "NULL::DATE, NULL::DATE"
#: Template, and (role, basis, currency, lo, hi, approximate, begins, ends, restates) of each fact.
REVENUE = [
    ("~A${a}k FY{y}", [f"'revenue', 'annual', 'AUD', a * 1000, a * 1000, true, {_FISCAL}, false"]),
    ("~A${b}M YTD FY{y} (A${a}M lifetime)", [f"'revenue', 'ytd', 'AUD', b * 1000000, b * 1000000, true, {_FISCAL}, false", f"'revenue', 'cumulative', 'AUD', a * 1000000, a * 1000000, false, {_NONE}, false"]),
    ("A${a}k (10mo FY{y}); A${b}k FY{y}", [f"'revenue', 'ytd', 'AUD', a * 1000, a * 1000, false, {_days('y - 1, 7', 'y, 4')}, false", f"'revenue', 'annual', 'AUD', b * 1000, b * 1000, false, {_FISCAL}, false"]),
    ("A${b}.5M+ cumulative; >A${a}k ARR", [f"'revenue', 'cumulative', 'AUD', b * 1000000 + 500000, NULL, true, {_NONE}, false", f"'revenue', 'arr', 'AUD', a * 1000, NULL, true, {_NONE}, false"]),
    ("~A${b}M forecast FY{y} (A${a}k prior)", [f"'revenue', 'forecast', 'AUD', b * 1000000, b * 1000000, true, {_FISCAL}, false", f"'revenue', 'annual', 'AUD', a * 1000, a * 1000, false, {_NONE}, false"]),
    ("~A${a}k annualised", [f"'revenue', 'annualised', 'AUD', a * 1000, a * 1000, true, {_NONE}, false"]),
    ("Seven figures within {b} months of launch", [f"'revenue', 'cumulative', NULL, 1000000, 9999999, false, {_NONE}, false"]),
    (">NZ${b}M turnover within 18 months", [f"'revenue', 'cumulative', 'NZD', b * 1000000, NULL, true, {_NONE}, false"]),
    ("~A${b}–{a}M (est.; Fast {a} #{b})", [f"'revenue', 'unknown', 'AUD', b * 1000000, a * 1000000, true, {_NONE}, false"]),
    ("Tracking ~£{b}M", [f"'revenue', 'forecast', 'GBP', b * 1000000, b * 1000000, true, {_NONE}, false"]),
    ("~A${b}M cumulative since 20{y}", [f"'revenue', 'cumulative', 'AUD', b * 1000000, b * 1000000, true, make_date(y, 1, 1), NULL::DATE, false"]),
    ("Not disclosed ({b}x growth over 2 yrs)", []),
]
FUNDING = [
    ("A${b}.2M equity CSF (OnMarket), Jul 20{y}, ${a}M pre-money", [f"'raised', NULL, 'AUD', b * 1000000 + 200000, b * 1000000 + 200000, false, {_days('y, 7', 'y, 7')}, false", f"'valuation', NULL, NULL, a * 1000000, a * 1000000, false, {_days('y, 7', 'y, 7')}, false"]),
    ("A${a}k equity CSF (Birchal), Jun–Jul 20{y}, {a} investors; ~A${b}M raised to date", [f"'raised', NULL, 'AUD', a * 1000, a * 1000, false, {_days('y, 6', 'y, 7')}, false", f"'raised_to_date', NULL, 'AUD', b * 1000000, b * 1000000, true, {_NONE}, false"]),
    ("A${b}M round closed; second ~A${a}k round underway (20{y}–{z})", [f"'raised', NULL, 'AUD', b * 1000000, b * 1000000, false, {_NONE}, false", f"'sought', NULL, 'AUD', a * 1000, a * 1000, true, {_days('y, 1', 'y + 1, 12')}, false"]),
    ("Up to A${b}M equity CSF (Birchal), Dec 20{y}", [f"'raised', NULL, 'AUD', NULL, b * 1000000, true, {_days('y, 12', 'y, 12')}, false"]),
    ("**Actively seeking NZ${b}M** at ~NZ${a}M valuation, Jun–Jul 20{y}", [f"'sought', NULL, 'NZD', b * 1000000, b * 1000000, false, {_days('y, 6', 'y, 7')}, false", f"'valuation', NULL, 'NZD', a * 1000000, a * 1000000, true, {_days('y, 6', 'y, 7')}, false"]),
    ("**£{b}.5M Series A open**, Feb 20{y}", [f"'sought', NULL, 'GBP', b * 1000000 + 500000, b * 1000000 + 500000, false, {_days('y, 2', 'y, 2')}, false"]),
    ("**Raising up to NZ${b}M**, Jul 20{y} (Snowball); NZ${a}k raised previously", [f"'sought', NULL, 'NZD', NULL, b * 1000000, true, {_days('y, 7', 'y, 7')}, false", f"'raised', NULL, 'NZD', a * 1000, a * 1000, false, {_NONE}, false"]),
    ("**US${b}M Seed**, Jul 20{y} (500 Fund, Ag) + A${a}k grant", [f"'raised', NULL, 'USD', b * 1000000, b * 1000000, false, {_days('y, 7', 'y, 7')}, false", f"'grant', NULL, 'AUD', a * 1000, a * 1000, false, {_days('y, 7', 'y, 7')}, false"]),
    ("**US$40M / £{b}M Series A**, 20{y}", [f"'raised', NULL, 'USD', 40000000, 40000000, false, {_days('y, 1', 'y, 12')}, false", f"'raised', NULL, 'GBP', b * 1000000, b * 1000000, false, {_days('y, 1', 'y, 12')}, abs(40 - 1.3::DOUBLE * b) <= 0.1::DOUBLE * greatest(40, 1.3::DOUBLE * b)"]),
    ("**US$40M / €{b}M Series A**, 20{y}", [f"'raised', NULL, 'USD', 40000000, 40000000, false, {_days('y, 1', 'y, 12')}, false", f"'raised', NULL, 'EUR', b * 1000000, b * 1000000, false, {_days('y, 1', 'y, 12')}, NULL::BOOLEAN"]),
    ("Near-seven-figure Seed, 14 Dec 20{y}", ["'raised', NULL, NULL, 100000, 1000000, false, make_date(y, 12, 14), make_date(y, 12, 14), false"]),
    ("Bootstrapped — no external round", []),
]


def _facts_sql(shapes: list) -> str:
    rows = [f"SELECT o_orderkey, {p + 1} AS place, {fact} FROM n WHERE o_orderkey % {len(shapes)} = {i}" for i, (_, facts) in enumerate(shapes) for p, fact in enumerate(facts)]
    return f"WITH n AS ({_SQL_NUMBERS}), f(o_orderkey, place, role, basis, currency, lo, hi, approximate, begins, ends, restates) AS ({' UNION ALL '.join(rows)}) SELECT o_orderkey, place::INT AS place, role, basis, currency, lo::DOUBLE AS lo, hi::DOUBLE AS hi, approximate, begins::VARCHAR AS begins, ends::VARCHAR AS ends, restates FROM f"


def _facts(spark: SparkSession, sf_dir: str, shapes: list, role: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", _chosen([t for t, _ in shapes], F.col("o_orderkey") % len(shapes), _numbers()).alias("cell"))
    f = money.money_facts(rows, "cell", role, RATES).select("o_orderkey", "fact.*")
    return f.select("o_orderkey", "place", "role", "basis", "currency", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "approximate", F.col("begins").cast("string").alias("begins"), F.col("ends").cast("string").alias("ends"), "restates")


def revenue_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every amount of revenue cells, with its basis, bounds and days."""
    return _facts(spark, sf_dir, REVENUE, "revenue")


def funding_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every amount of funding cells, with its role, bounds and days, and whether it is a round said again."""
    return _facts(spark, sf_dir, FUNDING, "raised")


STATUSES = [
    ("A${b}M round closed; second ~A${a}k round underway (20{y}–{z})", "raising"), (">A${b}M raised to date; active raise 20{y}", "raising"), ("**£{b}M Series A open**, Jul 20{y}", "raising"), ("**Opened to outside investment Jan 20{y}**", "raising"),
    ("None yet — founders state they are **open to investment**", "raising"), ("A${a}k grant (20{y}); **no external equity yet — actively considering a raise**", "raising"), ("**Actively raising seed**", "raising"), ("Raised via Snowball (prior round up to NZ${b}M)", "stated"),
    ("Bootstrapped — no external round", "none"), ("Zero external funding", "none"), ("A${b}M seed", "stated"), ("Not disclosed", "missing"), ("—", "missing"), ("Venture-backed (rounds predate window)", "stated"),
]


def open_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What funding cells say: an open raise or the intent of one, none, nothing, or something else."""
    cell = _chosen([t for t, _ in STATUSES], F.col("o_orderkey") % len(STATUSES), _numbers())
    return table(spark, sf_dir, "orders").select("o_orderkey", cells.status(cell).alias("status"))


BAND, CAP, WINDOW, PREFERRED = (1e6, 1e7), 1e7, ("2021-02-01", "2022-07-31"), 5e6
_QUALIFY_REVENUE = [("A${a}0k FY{y}", "a * 6500", "a * 6500"), (">A${b}00k ARR", "b * 65000", "NULL"), ("~A$1–{b}M (est.)", None, None), ("Not disclosed", None, None), ("Up to A${b}0k annualised", "NULL", "b * 6500"), ("A${b}M cumulative", None, None), ("€{b}M FY{y}", "NULL", "NULL")]
_QUALIFY_FUNDING = [
    ("A${b}.5M Seed, Jul 20{y}", "b * 650000 + 325000", "b * 650000 + 325000", "make_date(y, 7, 1)", "make_date(y, 7, 31)"), (">A${b}M Seed, 20{y}", "b * 650000", "NULL", "make_date(y, 1, 1)", "make_date(y, 12, 31)"), ("Up to NZ${b}M Seed, Jun–Jul 20{y}", "NULL", "b * 600000", "make_date(y, 6, 1)", "make_date(y, 7, 31)"),
    ("Never raised", None, None, None, None), ("Not disclosed", "NULL", "NULL", "NULL", "NULL"), ("Seeking A$1M, Jul 20{y}", "NULL", "NULL", "NULL", "NULL"), ("A${b}M seed", "b * 650000", "b * 650000", "NULL", "NULL"), ("A$1M Seed, 20{y}–{z}", "650000", "650000", "make_date(y, 1, 1)", "make_date(y + 1, 12, 31)"),
]


def qualified_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of a revenue band or a small recent round, decided from cells: true, false, or null."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _chosen([t for t, *_ in _QUALIFY_REVENUE], F.col("o_orderkey") % len(_QUALIFY_REVENUE), _numbers()).alias("revenue"), _chosen([t for t, *_ in _QUALIFY_FUNDING], F.col("o_custkey") % len(_QUALIFY_FUNDING), _numbers()).alias("funding"))
    return qualify.qualify(rows, "o_orderkey", "revenue", "funding", RATES, BAND, CAP, *WINDOW, PREFERRED)


def _qualified_sql() -> str:
    many = len(_QUALIFY_REVENUE)
    ends = lambda i: " ".join(f"WHEN o_orderkey % {many} = {k} THEN {s[i]}" for k, s in enumerate(_QUALIFY_REVENUE) if s[i])
    fund = lambda i: " ".join(f"WHEN c % {len(_QUALIFY_FUNDING)} = {k} THEN {s[i]}" for k, s in enumerate(_QUALIFY_FUNDING) if s[i])
    never = next(k for k, s in enumerate(_QUALIFY_FUNDING) if s[1] is None)
    verdict = lambda yes, no: f"CASE WHEN {yes} THEN true WHEN {no} THEN false END"
    return f"""
        WITH n AS (SELECT o_orderkey, o_custkey AS c, o_custkey % 900 + 100 AS a, o_orderkey % 90 + 10 AS b, (o_orderkey % 6 + 2020)::INT AS y FROM orders),
        i AS (SELECT o_orderkey, c, CASE {ends(1)} END AS rl, CASE {ends(2)} END AS rh, CASE {fund(1)} END AS fl, CASE {fund(2)} END AS fh, CASE {fund(3)} END AS f, CASE {fund(4)} END AS t FROM n),
        v AS (SELECT o_orderkey, {verdict(f'rl >= {BAND[0]} AND rh <= {BAND[1]}', f'rh < {BAND[0]} OR rl > {BAND[1]}')} AS revenue_in_band, {verdict(f'rh < {PREFERRED}', f'rl >= {PREFERRED}')} AS preferred,
          CASE WHEN c % {len(_QUALIFY_FUNDING)} = {never} THEN false ELSE {verdict(f'fh < {CAP}', f'fl >= {CAP}')} AND {verdict(f"f >= DATE '{WINDOW[0]}' AND t <= DATE '{WINDOW[1]}'", f"t < DATE '{WINDOW[0]}' OR f > DATE '{WINDOW[1]}'")} END AS round_in_window FROM i)
        SELECT o_orderkey, revenue_in_band, round_in_window, revenue_in_band OR round_in_window AS qualifies, preferred FROM v"""


def _supplier() -> dict[str, Column]:
    return {"k": F.col("s_suppkey"), "t": F.floor(F.col("s_suppkey") / 30)}


_NAMES = ["Firm{k} Foods Co.", "Firm{k} Foods (formerly Old{k}, Twin{t})", "Firm{k} & Sons / Shop{k}", "Firm{k} (by Maker{k})"]
_MENTIONS = ["Firm{k} at C$20M", "arguably old{k}", "Twin{t}", "FÎRM{k} FOODS", "Shop{k} of the year"]


def resolved_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the prose of caveats, a text a nation, resolved to the suppliers that they mean."""
    supplier = table(spark, sf_dir, "supplier")
    entries = supplier.select("s_suppkey", _chosen(_NAMES, F.col("s_suppkey") % len(_NAMES), _supplier()).alias("name"))
    mention = _chosen(_MENTIONS, F.col("s_suppkey") % len(_MENTIONS), _supplier())
    prose = supplier.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(mention)).alias("m"))  # a nation's prose is one text
    prose = prose.select("s_nationkey", F.concat(F.lit("**Above the band** ("), F.array_join("m", ", "), F.lit(", and Nobody) — kept")).alias("text"))
    return names.resolve(names.listed(prose, "text"), "mention", entries, "s_suppkey", "name").select("s_nationkey", "mention", "verdict", "s_suppkey", "matches")


_PEOPLE = ["Ann{k} Bo (founder); Cy Dee{k} (CEO)", "Ed{k} & Flo{k} (co-founders)", "Gus{k} Hay + co-founders", "Ida{k} (The Baker, of Ayr) + partner", "Founder of Jam{k}", "Prof. Kay{k} Lee, Max Ng, Oz Po", "—"]


def named_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People in founder cells, with their roles and notes."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", _chosen(_PEOPLE, F.col("s_suppkey") % len(_PEOPLE), _supplier()).alias("cell"))
    return rows.select("s_suppkey", F.inline(parts.people(F.col("cell"))))


_BRANDS = ["Firm{k} (One{k}, Two & Three, Maison&Four)", "Firm{k} (formerly Old{k})", "Firm{k} (by Maker{k})", "Firm{k} / Shop{k}", "Firm{k}", "Firm{k} Co. (Little {k})"]


def entry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main names, and the other names that stand beside them, by kind."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", _chosen(_BRANDS, F.col("s_suppkey") % len(_BRANDS), _supplier()).alias("cell"))
    return rows.select("s_suppkey", parts.main_name(F.col("cell")).alias("main"), F.inline_outer(parts.other_names(F.col("cell"))))


_SOURCES = [("Daily {a} 14 Jul 20{y}; Offer page; Food & Trade Apr 20{y}", 2), ("Company site", 0), ("Fast {a} 20{y}", 1), ("—", None), ("Inside {b}; The Herald", 0)]


def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a high level without a dated source, or with one that is too old, and those of no known level."""
    level = F.when(F.col("o_custkey") % 4 == 0, "High").when(F.col("o_custkey") % 4 == 1, "Med").when(F.col("o_custkey") % 4 == 2, "Sure")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", level.alias("level"), _chosen([t for t, _ in _SOURCES], F.col("o_orderkey") % len(_SOURCES), _numbers()).alias("sources"))
    high = F.col("level") == "High"
    return rules.violations(rows, "o_orderkey", {"high has a dated source": (high, rules.dated(F.col("sources"))), "high has a source since 2023": (high, rules.dated(F.col("sources"), F.lit("2023-01-01").cast("date"))), "level is known": (F.lit(True), rules.named(F.col("level"), ("High", "Med", "Low")))})


def source_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a cell as publisher and days."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _chosen([t for t, _ in _SOURCES], F.col("o_orderkey") % len(_SOURCES), _numbers()).alias("cell"))
    found = rows.select("o_orderkey", F.inline(parts.sources(F.col("cell"))))
    return found.groupBy("publisher", "begins", "ends").agg(F.count("*").alias("orders")).withColumns({c: F.col(c).cast("string") for c in ("begins", "ends")})


_LISTS = ("2024-01-01", "2024-04-01", "2024-07-01", "2024-10-01", "2025-01-01")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five whole lists: orders leave and come back, statuses change, and some orders stand in a list twice."""
    n, t = F.col("o_orderkey"), F.col("t")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.posexplode(F.array(*[F.lit(d).cast("date") for d in _LISTS])).alias("t", "as_of")).where((n + t) % 7 > 1)
    rows = rows.withColumn("o_orderstatus", F.when((n % 5 == 0) & (t >= n % 4), "X").when(n % 11 != 0, F.col("o_orderstatus"))).withColumn("page", F.lit(1))
    again = rows.where((n % 13 == 0) & (t == 2)).withColumn("o_orderstatus", F.lit("Y")).withColumn("page", F.lit(2))
    return rows.unionByName(again)


def entry_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity intervals of entries over successive lists."""
    found = history.validity(_lists(spark, sf_dir), "o_orderkey", "as_of", ["o_orderstatus"], F.col("page"))
    return found.withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_to")})


def entry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each list adds, removes and changes."""
    found = history.changes(_lists(spark, sf_dir), "o_orderkey", "as_of", ["o_orderstatus"], F.col("page"))
    return found.select(F.col("as_of").cast("string").alias("as_of"), "o_orderkey", "change", F.array_join("columns", ",").alias("columns"))


def filled_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' missing segments and balances filled from two sources, the surer one first."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 3 == 0, "Med").alias("segment_conf"), F.when(k % 4 == 0, F.col("c_acctbal")).alias("balance"), F.when(k % 4 == 0, "High").alias("balance_conf"))
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    first = keys.select("c_custkey", F.lit("segment").alias("column"), F.concat(F.lit("A"), k.cast("string")).alias("value"), F.lit("alpha").alias("source"), F.when(k % 2 == 0, "Low").otherwise("Med").alias("confidence"))
    second = keys.where(k % 5 != 0).select("c_custkey", F.lit("segment"), F.concat(F.lit("B"), k.cast("string")), F.lit("beta"), F.when(k % 7 == 0, "High").otherwise("Med"))
    third = keys.where(k % 2 == 0).select("c_custkey", F.lit("balance"), (k % 1000).cast("string"), F.lit("beta"), F.when(k % 6 == 0, "Guess").otherwise("Low"))
    return provenance.enrich(base, "c_custkey", {"segment": "segment_conf", "balance": "balance_conf"}, first.union(second).union(third)).drop("segment_conf", "balance_conf")


def claimed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that state how many customers a nation has, some of them wrongly, against the rows."""
    counted = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("counted"))
    n, k = F.col("counted"), F.col("nation")
    template = ["## Nation {k} ({n} companies)", "Roughly {r} established companies, of 3 kinds", "at least {m} companies are listed", "{n}–{m} companies in 2025", "twenty-one companies", "no number of companies"]
    numbers = {"k": k, "n": n, "r": F.floor(n * 1.05), "m": n + 1}
    prose = counted.select("nation", _chosen(template, k % len(template), numbers).alias("text"))
    stated = claims.claims(prose, "text", ("companies", "company", "kinds")).where("claim.thing = 'companies'")
    return claims.reconcile(stated, counted.where(k != 5), ["nation"])


_TEAMS = ["{p} FTE + ~60 casual", "~{p}–99 (est.)", "{p}", "{p}+ staff", "—", "about {p} people and 3 interns"]


def team_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every count of staff cells, with its kind."""
    rows = table(spark, sf_dir, "part").select("p_partkey", _chosen(_TEAMS, F.col("p_partkey") % len(_TEAMS), {"p": F.col("p_size")}).alias("cell"))
    return rows.select("p_partkey", F.inline(parts.head_counts(F.col("cell"))))


_ALL = (revenue_facts, funding_facts, open_rounds, qualified_entries, resolved_mentions, named_people, entry_names, rule_violations, source_dates, entry_history, entry_changes, filled_contacts, claimed_counts, team_counts)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_LISTS_SQL = """
        d AS (SELECT * FROM (VALUES {days}) AS x(t, as_of)),
        l AS (SELECT o_orderkey, t, as_of, CASE WHEN o_orderkey % 13 = 0 AND t = 2 THEN 'Y' WHEN o_orderkey % 5 = 0 AND t >= o_orderkey % 4 THEN 'X' WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS s,
          o_orderkey % 13 = 0 AND t = 2 AS torn FROM orders, d WHERE (o_orderkey + t) % 7 > 1)""".format(days=", ".join(f"({t}, DATE '{d}')" for t, d in enumerate(_LISTS)))

SQL: dict[str, str] = {
    "revenue_facts": _facts_sql(REVENUE),
    "funding_facts": _facts_sql(FUNDING),
    "open_rounds": f"SELECT o_orderkey, [{', '.join(repr(s) for _, s in STATUSES)}][(o_orderkey % {len(STATUSES)} + 1)::INT] AS status FROM orders",
    "qualified_entries": _qualified_sql(),
    "resolved_mentions": """
        WITH s AS (SELECT s_nationkey, s_suppkey AS k, s_suppkey // 30 AS t FROM supplier),
        twins AS (SELECT t, count(*) AS n, min(k) AS k FROM s WHERE k % 4 = 1 GROUP BY t),
        m AS (SELECT s_nationkey, k, t, CASE k % 5 WHEN 0 THEN 'Firm' || k WHEN 1 THEN 'old' || k WHEN 2 THEN 'Twin' || t WHEN 3 THEN 'FÎRM' || k || ' FOODS' ELSE 'Shop' || k || ' of the year' END AS mention,
          CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN (k % 4 = 1)::INT WHEN 2 THEN -1 WHEN 3 THEN (k % 4 <> 2)::INT ELSE (k % 4 = 2)::INT END AS hits FROM s),
        f AS (SELECT s_nationkey, mention, CASE WHEN hits < 0 THEN coalesce(n, 0) ELSE hits END AS matches, CASE WHEN hits < 0 THEN twins.k ELSE m.k END AS k FROM m LEFT JOIN twins USING (t)
          UNION ALL SELECT DISTINCT s_nationkey, 'Nobody', 0, NULL FROM s)
        SELECT s_nationkey, mention, CASE WHEN matches = 1 THEN 'resolved' WHEN matches > 1 THEN 'ambiguous' ELSE 'unmatched' END AS verdict, CASE WHEN matches = 1 THEN k END AS s_suppkey, matches::BIGINT AS matches FROM f""",
    "named_people": """
        WITH s AS (SELECT s_suppkey, s_suppkey AS k FROM supplier),
        p AS (SELECT s_suppkey, unnest(CASE k % 7
          WHEN 0 THEN [{'n': 'Ann' || k || ' Bo', 'r': 'founder', 'o': NULL}, {'n': 'Cy Dee' || k, 'r': 'ceo', 'o': NULL}] WHEN 1 THEN [{'n': 'Ed' || k, 'r': 'co-founder', 'o': NULL}, {'n': 'Flo' || k, 'r': 'co-founder', 'o': NULL}]
          WHEN 2 THEN [{'n': 'Gus' || k || ' Hay', 'r': NULL, 'o': NULL}, {'n': NULL, 'r': 'co-founders', 'o': NULL}] WHEN 3 THEN [{'n': 'Ida' || k, 'r': NULL, 'o': 'The Baker, of Ayr'}, {'n': NULL, 'r': 'partner', 'o': NULL}]
          WHEN 4 THEN [{'n': NULL, 'r': 'founder', 'o': 'Jam' || k}] WHEN 5 THEN [{'n': 'Prof. Kay' || k || ' Lee', 'r': NULL, 'o': NULL}, {'n': 'Max Ng', 'r': NULL, 'o': NULL}, {'n': 'Oz Po', 'r': NULL, 'o': NULL}] ELSE [] END) AS x FROM s)
        SELECT s_suppkey, x.n AS name, x.r AS role, x.o AS note FROM p""",
    "entry_names": """
        WITH s AS (SELECT s_suppkey, s_suppkey AS k FROM supplier),
        n AS (SELECT s_suppkey, 'Firm' || k || CASE WHEN k % 6 = 5 THEN ' Co.' ELSE '' END AS main, unnest(CASE k % 6
          WHEN 0 THEN [{'k': 'brand', 'n': 'One' || k}, {'k': 'brand', 'n': 'Two'}, {'k': 'brand', 'n': 'Three'}, {'k': 'brand', 'n': 'Maison&Four'}] WHEN 1 THEN [{'k': 'former', 'n': 'Old' || k}] WHEN 2 THEN [{'k': 'maker', 'n': 'Maker' || k}]
          WHEN 3 THEN [{'k': 'other', 'n': 'Shop' || k}] WHEN 4 THEN [{'k': NULL, 'n': NULL}] ELSE [{'k': 'brand', 'n': 'Little ' || k}] END) AS x FROM s)
        SELECT s_suppkey, main, x.k AS kind, x.n AS name FROM n""",
    "rule_violations": """
        WITH r AS (SELECT o_orderkey, o_orderkey % 5 AS s, (o_orderkey % 6 + 2020)::INT AS y, CASE o_custkey % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Med' WHEN 2 THEN 'Sure' END AS level FROM orders)
        SELECT o_orderkey, 'high has a dated source' AS rule, CASE WHEN s = 3 THEN 'undecided' ELSE 'violated' END AS verdict FROM r WHERE level = 'High' AND s IN (1, 3, 4)
        UNION ALL SELECT o_orderkey, 'high has a source since 2023', CASE WHEN s = 3 THEN 'undecided' ELSE 'violated' END FROM r WHERE level = 'High' AND NOT (s IN (0, 2) AND y >= 2023)
        UNION ALL SELECT o_orderkey, 'level is known', 'violated' FROM r WHERE level = 'Sure'""",
    "source_dates": f"""
        WITH n AS ({_SQL_NUMBERS}),
        s AS (SELECT unnest(CASE o_orderkey % 5 WHEN 0 THEN [{{'p': 'Daily ' || a, 'b': make_date(y, 7, 14), 'e': make_date(y, 7, 14)}}, {{'p': 'Offer page', 'b': NULL, 'e': NULL}}, {{'p': 'Food & Trade', 'b': make_date(y, 4, 1), 'e': make_date(y, 4, 30)}}]
          WHEN 1 THEN [{{'p': 'Company site', 'b': NULL, 'e': NULL}}] WHEN 2 THEN [{{'p': 'Fast ' || a, 'b': make_date(y, 1, 1), 'e': make_date(y, 12, 31)}}] WHEN 3 THEN [] ELSE [{{'p': 'Inside ' || b, 'b': NULL, 'e': NULL}}, {{'p': 'The Herald', 'b': NULL, 'e': NULL}}] END) AS x FROM n)
        SELECT x.p AS publisher, x.b::VARCHAR AS begins, x.e::VARCHAR AS ends, count(*)::BIGINT AS orders FROM s GROUP BY ALL""",
    "entry_history": f"""
        WITH {_LISTS_SQL},
        g AS (SELECT *, coalesce(lag(t) OVER w = t - 1 AND lag(s) OVER w IS NOT DISTINCT FROM s, false) AS same FROM l WINDOW w AS (PARTITION BY o_orderkey ORDER BY t)),
        i AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY o_orderkey ORDER BY t) AS n FROM g),
        r AS (SELECT o_orderkey, s, min(as_of) AS f, max(t) AS last, bool_or(torn) AS conflicting FROM i GROUP BY o_orderkey, n, s),
        e AS (SELECT r.*, d.as_of AS until, lead(f) OVER (PARTITION BY o_orderkey ORDER BY f) AS follow FROM r LEFT JOIN d ON d.t = last + 1)
        SELECT o_orderkey, s AS o_orderstatus, f::VARCHAR AS valid_from, until::VARCHAR AS valid_to, CASE WHEN until IS NULL THEN NULL WHEN follow = until THEN 'changed' ELSE 'vanished' END AS ended, conflicting FROM e""",
    "entry_changes": f"""
        WITH {_LISTS_SQL},
        b AS (SELECT coalesce(n.o_orderkey, p.o_orderkey) AS o_orderkey, coalesce(n.t, p.t + 1) AS t, n.t IS NULL AS gone, p.t IS NULL AS fresh, n.s AS x, p.s AS z FROM (SELECT * FROM l WHERE t > 0) n FULL JOIN (SELECT * FROM l WHERE t < 4) p ON n.o_orderkey = p.o_orderkey AND n.t = p.t + 1)
        SELECT as_of::VARCHAR AS as_of, o_orderkey, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change, CASE WHEN NOT fresh AND NOT gone THEN 'o_orderstatus' END AS "columns"
        FROM b JOIN d USING (t) WHERE fresh OR gone OR x IS DISTINCT FROM z""",
    "filled_contacts": """
        WITH k AS (SELECT c_custkey AS k, c_mktsegment, c_acctbal FROM customer),
        s AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'list' WHEN k % 5 <> 0 AND (k % 7 = 0 OR k % 2 = 0) THEN 'beta' ELSE 'alpha' END AS src FROM k)
        SELECT k AS c_custkey, CASE src WHEN 'list' THEN c_mktsegment WHEN 'beta' THEN 'B' || k ELSE 'A' || k END AS segment, src AS segment_source,
          CASE src WHEN 'list' THEN 'Med' WHEN 'beta' THEN CASE WHEN k % 7 = 0 THEN 'High' ELSE 'Med' END ELSE CASE WHEN k % 2 = 0 THEN 'Low' ELSE 'Med' END END AS segment_confidence,
          CASE WHEN k % 4 = 0 THEN c_acctbal WHEN k % 2 = 0 AND k % 6 <> 0 THEN (k % 1000)::DOUBLE END AS balance, CASE WHEN k % 4 = 0 THEN 'list' WHEN k % 2 = 0 AND k % 6 <> 0 THEN 'beta' END AS balance_source,
          CASE WHEN k % 4 = 0 THEN 'High' WHEN k % 2 = 0 AND k % 6 <> 0 THEN 'Low' END AS balance_confidence FROM s""",
    "claimed_counts": """
        WITH c AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1),
        s AS (SELECT nation, n, nation % 6 AS m, CASE nation % 6 WHEN 0 THEN n WHEN 1 THEN floor(n * 1.05)::BIGINT WHEN 2 THEN n + 1 WHEN 3 THEN n WHEN 4 THEN 21 END AS lo, CASE nation % 6 WHEN 0 THEN n WHEN 1 THEN floor(n * 1.05)::BIGINT WHEN 3 THEN n + 1 WHEN 4 THEN 21 END AS hi FROM c)
        SELECT nation, lo::BIGINT AS lo, hi::BIGINT AS hi, CASE WHEN m < 5 THEN m = 1 END AS approximate, CASE WHEN nation <> 5 THEN n END AS counted,
          CASE WHEN m = 5 THEN 'unstated' WHEN m = 2 THEN 'differs' WHEN m = 4 AND n <> 21 THEN 'differs' ELSE 'agrees' END AS verdict FROM s WHERE NOT (nation = 5)""",
    "team_counts": """
        WITH p AS (SELECT p_partkey, p_size AS n, unnest(CASE p_partkey % 6 WHEN 0 THEN [{'l': p_size, 'h': p_size, 'e': false, 'k': 'FTE'}, {'l': 60, 'h': 60, 'e': true, 'k': 'casual'}] WHEN 1 THEN [{'l': p_size, 'h': 99, 'e': true, 'k': NULL}] WHEN 2 THEN [{'l': p_size, 'h': p_size, 'e': false, 'k': NULL}]
          WHEN 3 THEN [{'l': p_size, 'h': NULL, 'e': false, 'k': 'staff'}] WHEN 4 THEN [] ELSE [{'l': p_size, 'h': p_size, 'e': true, 'k': 'people'}, {'l': 3, 'h': 3, 'e': false, 'k': 'interns'}] END) AS x FROM part)
        SELECT p_partkey, x.l::INT AS lo, x.h::INT AS hi, x.e AS is_estimate, x.k AS kind FROM p""",
}
