"""Registered queries over the star schema and, for each, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import cells, money
from tessella.operators import lists
from tessella.sources import pipe_tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def regional_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per region against a target."""
    customers = table(spark, sf_dir, "customer").join(nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("region"))
    target = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"), (F.lit(100) * (F.col("r_regionkey") + 1)).cast("long").alias("target"))
    return lists.against_target(customers, "region", target)


def qualified_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revenue band or a recent small order; unknown balances (below 0) make the rule null."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("total"), F.max("o_orderdate").alias("closed"))
    customers = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    revenue = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    since, until = (F.lit(d).cast("timestamp_ntz") for d in ("1995-01-01", "1998-12-31"))
    rule = lists.qualifies(revenue, 1000.0, 5000.0, F.col("total"), 100000.0, F.col("closed"), since, until)
    return customers.select("c_custkey", rule.alias("qualifies"), (revenue < 2500.0).alias("preferred"))


def confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per confidence level, and which levels to verify first."""
    urgency = F.substring("o_orderpriority", 1, 1)
    level = F.when(urgency == "1", "High").when(urgency == "2", "Med").when(urgency.isin("3", "4"), "Low")
    rows = table(spark, sf_dir, "orders").select(level.alias("level"))
    return rows.groupBy("level").agg(F.count("*").alias("orders")).select("level", lists.confidence_rank(F.col("level")).alias("rank"), (F.col("level") == "Low").alias("verify"), "orders")


def column_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of each column say something, after missing marks."""
    part = table(spark, sf_dir, "part")
    marked = part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, "Not disclosed").when(F.col("p_size") % 5 == 0, " — ").otherwise(F.col("p_brand")).alias("brand"), "p_type")
    return lists.coverage(marked.select("p_partkey", cells.known(F.col("brand")).alias("brand"), "p_type"), ["p_partkey", "brand", "p_type"])


def one_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers, whose columns differ, as one list of two sections."""
    return lists.conform([
        (table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), {"c_custkey": "entry", "c_name": "name", "c_acctbal": "balance", "c_mktsegment": "segment"}, {"section": F.lit(1)}),
        (table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), {"s_suppkey": "entry", "s_name": "name", "s_acctbal": "balance"}, {"section": F.lit(2)}),
    ])


def screened_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' totals at screening rates that only some currencies have."""
    rates = spark.createDataFrame([("AUD", 0.65), ("NZD", 0.60), ("USD", 1.0)], "currency string, rate double")
    code = F.element_at(F.array(*map(F.lit, ("AUD", "NZD", "USD", "GBP", "EUR"))), (F.col("o_custkey") % 5 + 1).cast("int"))
    orders = lists.convert(table(spark, sf_dir, "orders").select("o_totalprice", code.alias("currency")), "o_totalprice", "currency", rates, "usd")
    return orders.groupBy("currency").agg(F.count("*").alias("orders"), F.count("usd").alias("converted"), F.round(F.sum(F.col("usd").cast("decimal(18,4)")), 2).cast("double").alias("usd"))


def _caveats(supplier: DataFrame) -> DataFrame:
    return supplier.where("s_acctbal < 0").select("s_suppkey", F.lit("below").alias("class")).union(supplier.where("s_nationkey >= 20").select("s_suppkey", F.lit("outside").alias("class")))


def strict_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers without a caveat: a negative balance, or a nation above the last five."""
    supplier = table(spark, sf_dir, "supplier")
    return lists.strict(supplier, _caveats(supplier), "s_suppkey").select("s_suppkey", "s_name")


def type_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts per word of a cell of several values."""
    joined = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_type", " ", " ; ").alias("types"))
    return joined.select(F.explode(cells.many(F.col("types"))).alias("word")).groupBy("word").agg(F.count("*").alias("parts"))


def _money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a cell of prose in one of seven shapes."""
    whole, customer = F.floor("o_totalprice").cast("string"), F.col("o_custkey").cast("string")
    shapes = [
        F.concat(F.lit("A$"), whole, F.lit(" raised; seeking US$"), (F.col("o_custkey") % 90 + 1).cast("string"), F.lit("k")),
        F.concat(F.lit("£"), whole, F.lit(" valuation")),
        F.when(F.col("o_custkey") % 2 == 0, "Not disclosed").otherwise("Not disclosed (growth of £2m)"),
        F.concat(F.lit("€"), customer, F.lit("m grant")),
        F.concat(F.lit("A$"), customer, F.lit("k round at A$"), whole, F.lit(" valuation")),
        F.concat(F.lit("Raised US$"), customer, F.lit(" and seeking US$"), whole),
        F.concat(F.lit("£"), customer, F.lit("k–£"), whole, F.lit("k revenue in FY25 (forecast ~NZ$2.5m revenue)")),
    ]
    cell = F.element_at(F.array(*shapes), (F.col("o_orderkey") % len(shapes) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", cell.alias("cell"))


def money_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every amount read from prose, by role, basis and currency."""
    f = F.col("fact")
    facts = money.money_facts(_money(spark, sf_dir), "cell").select("fact.*", F.when(f["hi"] != f["lo"], f["hi"]).alias("amount_to"))
    return facts.groupBy("role", "basis", "currency", "period", "approximate").agg(F.count("*").alias("facts"), F.sum("lo").cast("double").alias("amount"), F.sum("amount_to").cast("double").alias("amount_to"))


def money_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cells say: missing (with or without a remark), an open raise, or a statement."""
    rows = _money(spark, sf_dir).select(cells.status(F.col("cell")).alias("status"), cells.remark(F.col("cell")).alias("remark"))
    return rows.groupBy("status", "remark").agg(F.count("*").alias("orders"))


def future_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a period after the list's year are flagged."""
    facts = money.money_facts(_money(spark, sf_dir), "cell").select("fact.*")
    return lists.flagged(facts, lists.after(F.col("period"), 2024), "ahead").groupBy("ahead").agg(F.count("*").alias("facts"))


def supplier_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the classes of their caveats."""
    supplier = table(spark, sf_dir, "supplier")
    return lists.with_caveats(supplier, _caveats(supplier), "s_suppkey").select("s_suppkey", F.array_join("caveats", ",").alias("caveats"))


def confident_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by confidence level, in either or both of two columns."""
    named = lambda c: F.when(c == 1, "High").when(c == 2, "Med").when(c < 5, "Low")
    rows = table(spark, sf_dir, "orders").select(named(F.substring("o_orderpriority", 1, 1).cast("int")).alias("first"), named(F.col("o_custkey") % 6).alias("second"))
    return lists.levels(rows, ["first", "second"])


def mix_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per region against ranges, the last region having the remainder."""
    customers = table(spark, sf_dir, "customer").join(nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("region"))
    n = F.col("r_regionkey")
    bounded = n < 4
    targets = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"), F.when(bounded, 20 * n + 10).cast("long").alias("lo"), F.when(bounded, 80 * n + 40).cast("long").alias("hi"))
    return lists.against_ranges(customers, "region", targets)


def valued_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with their confidence in the same cell."""
    level = F.element_at(F.array(*map(F.lit, ("High", "Med", "Low"))), (F.col("p_size") % 3 + 1).cast("int"))
    cell = F.when(F.col("p_size") % 5 == 0, "—").when(F.col("p_size") % 5 == 1, F.col("p_brand")).otherwise(F.concat(F.lit("**"), F.col("p_brand"), F.lit("** ("), level, F.lit(")")))
    rows = table(spark, sf_dir, "part").select(cells.valued(cell).alias("v"))
    return rows.groupBy(F.col("v.value").alias("value"), F.col("v.confidence").alias("confidence")).agg(F.count("*").alias("parts"))


def staff_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges read from text such as "~10–20 (est.)"."""
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("~"), size, F.lit("–"), (F.col("p_size") + 10).cast("string"), F.lit(" (est.)")))
    text = text.when(F.col("p_size") % 3 == 1, F.concat(size, F.when(F.col("p_size") % 2 == 0, " FTE, latest count").otherwise(""))).otherwise("—")
    rows = table(spark, sf_dir, "part").select(cells.number_range(text).alias("r"))
    return rows.groupBy(F.col("r.is_estimate").alias("is_estimate"), F.col("r.note").alias("note")).agg(F.count("*").alias("parts"), F.sum("r.lo").alias("lo"), F.sum("r.hi").alias("hi"))


def other_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Former names in a name cell."""
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" (formerly Old "), F.col("s_suppkey").cast("string"), F.lit(", Older)"))).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(cells.aliases(name)).alias("alias"))


def open_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of an open status, those within a range of entries flagged as weak."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return lists.flagged(orders.select("o_orderkey"), F.col("o_orderkey").between(56, 60))


def enriched_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with what a local file knows of them; those that it lacks stay."""
    contacts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("contact"))
    return table(spark, sf_dir, "customer").join(contacts, "c_custkey", "left").select("c_custkey", "c_name", "contact")


def refreshed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after a refresh that changes some and adds some."""
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = base.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("R").alias("o_orderstatus"), F.col("o_totalprice") + 1)
    more = base.where("o_orderkey % 11 = 0").select(-F.col("o_orderkey") - 1, "o_orderstatus", "o_totalprice")
    return lists.refresh(base, changes.union(more).toDF(*base.columns), "o_orderkey")


def nations_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as a pipe table under a heading per region, and read back."""
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.col("n_name"), F.lit(" |"))
    pages = nations(spark, sf_dir).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("rows"))
    pages = pages.select(F.col("r_name").alias("path"), F.concat(F.lit("# "), F.col("r_name"), F.lit("\n\n| Key | Name |\n|---|:--|\n"), F.col("rows"), F.lit("\n\ntext")).alias("text"))
    rows = pipe_tables.parse_pipe_tables(pages)
    return rows.select("section", F.col("cells.Key").cast("int").alias("n_nationkey"), F.col("cells.Name").alias("n_name"))


_ALL = (regional_mix, qualified_customers, confidence_levels, column_coverage, one_list, screened_totals, strict_suppliers, type_words, money_by_role, money_status, future_facts, supplier_caveats, confident_entries, mix_in_ranges, valued_cells, staff_ranges, other_names, open_entries, enriched_customers, refreshed_orders, nations_by_table)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

SQL: dict[str, str] = {
    "regional_mix": "SELECT r_name AS region, 100 * (r_regionkey + 1)::BIGINT AS target, count(c_custkey)::BIGINT AS delivered, (count(c_custkey) - 100 * (r_regionkey + 1))::BIGINT AS gap FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, r_regionkey",
    "qualified_customers": """
        WITH last AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS total, max(o_orderdate) AS closed FROM orders GROUP BY 1),
        c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS revenue, total, closed FROM customer LEFT JOIN last ON c_custkey = o_custkey)
        SELECT c_custkey, (revenue BETWEEN 1000 AND 5000) OR (total < 100000 AND closed BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31') AS qualifies, revenue < 2500 AS preferred FROM c""",
    "confidence_levels": """
        WITH l AS (SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'High' WHEN '2' THEN 'Med' WHEN '3' THEN 'Low' WHEN '4' THEN 'Low' END AS level FROM orders)
        SELECT level, CASE level WHEN 'High' THEN 3 WHEN 'Med' THEN 2 WHEN 'Low' THEN 1 END AS rank, level = 'Low' AS verify, count(*)::BIGINT AS orders FROM l GROUP BY level""",
    "column_coverage": """
        WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN NULL ELSE p_brand END AS brand, p_type FROM part)
        SELECT 'p_partkey' AS "column", count(*)::BIGINT AS "rows", count(p_partkey)::BIGINT AS present, count(DISTINCT p_partkey)::BIGINT AS distinct_values FROM p
        UNION ALL SELECT 'brand', count(*), count(brand), count(DISTINCT brand) FROM p UNION ALL SELECT 'p_type', count(*), count(p_type), count(DISTINCT p_type) FROM p""",
    "one_list": "SELECT c_custkey AS entry, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 1 AS section FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 2 FROM supplier",
    "screened_totals": """
        WITH o AS (SELECT o_totalprice, ['AUD', 'NZD', 'USD', 'GBP', 'EUR'][(o_custkey % 5 + 1)::INT] AS currency FROM orders),
        r AS (SELECT * FROM (VALUES ('AUD', 0.65::DOUBLE), ('NZD', 0.60::DOUBLE), ('USD', 1.0::DOUBLE)) AS v(currency, rate))
        SELECT currency, count(*)::BIGINT AS orders, count(rate)::BIGINT AS converted, round(sum((o_totalprice * rate)::DECIMAL(18, 4)), 2)::DOUBLE AS usd FROM o LEFT JOIN r USING (currency) GROUP BY currency""",
    "strict_suppliers": "SELECT s_suppkey, s_name FROM supplier WHERE NOT (s_acctbal < 0 OR s_nationkey >= 20)",
    "type_words": "SELECT word, count(*)::BIGINT AS parts FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY word",
    "money_by_role": """
        WITH o AS (SELECT o_orderkey % 7 AS k, floor(o_totalprice) AS whole, o_custkey AS c FROM orders),
        f AS (
          SELECT 'raised' AS role, NULL AS basis, 'AUD' AS currency, NULL AS period, false AS approximate, whole AS amount, NULL::DOUBLE AS amount_to FROM o WHERE k = 0
          UNION ALL SELECT 'sought', NULL, 'USD', NULL, false, (c % 90 + 1) * 1000, NULL FROM o WHERE k = 0
          UNION ALL SELECT 'valuation', NULL, 'GBP', NULL, false, whole, NULL FROM o WHERE k = 1
          UNION ALL SELECT 'grant', NULL, 'EUR', NULL, false, c * 1000000, NULL FROM o WHERE k = 3
          UNION ALL SELECT 'raised', NULL, 'AUD', NULL, false, c * 1000, NULL FROM o WHERE k = 4
          UNION ALL SELECT 'valuation', NULL, 'AUD', NULL, false, whole, NULL FROM o WHERE k = 4
          UNION ALL SELECT 'raised', NULL, 'USD', NULL, false, c, NULL FROM o WHERE k = 5
          UNION ALL SELECT 'sought', NULL, 'USD', NULL, false, whole, NULL FROM o WHERE k = 5
          UNION ALL SELECT 'revenue', 'annual', 'GBP', 'FY25', false, c * 1000, whole * 1000 FROM o WHERE k = 6
          UNION ALL SELECT 'revenue', 'forecast', 'NZD', NULL, true, 2500000, NULL FROM o WHERE k = 6)
        SELECT role, basis, currency, period, approximate, count(*)::BIGINT AS facts, sum(amount)::DOUBLE AS amount, sum(amount_to)::DOUBLE AS amount_to FROM f GROUP BY ALL""",
    "money_status": """
        WITH o AS (SELECT o_orderkey % 7 AS k, o_custkey AS c FROM orders)
        SELECT CASE WHEN k = 2 THEN 'missing' WHEN k IN (0, 5) THEN 'raising' ELSE 'stated' END AS status, CASE WHEN k = 2 AND c % 2 = 1 THEN '(growth of £2m)' END AS remark, count(*)::BIGINT AS orders FROM o GROUP BY ALL""",
    "future_facts": "SELECT ahead, count(*)::BIGINT AS facts FROM (SELECT unnest(CASE o_orderkey % 7 WHEN 0 THEN [false, false] WHEN 1 THEN [false] WHEN 2 THEN [] WHEN 3 THEN [false] WHEN 6 THEN [true, false] ELSE [false, false] END) AS ahead FROM orders) GROUP BY ahead",
    "supplier_caveats": "SELECT s_suppkey, concat_ws(',', CASE WHEN s_acctbal < 0 THEN 'below' END, CASE WHEN s_nationkey >= 20 THEN 'outside' END) AS caveats FROM supplier",
    "confident_entries": """
        WITH r AS (SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'High' WHEN '2' THEN 'Med' WHEN '3' THEN 'Low' WHEN '4' THEN 'Low' END AS f, CASE o_custkey % 6 WHEN 0 THEN 'Low' WHEN 1 THEN 'High' WHEN 2 THEN 'Med' WHEN 3 THEN 'Low' WHEN 4 THEN 'Low' END AS s FROM orders)
        SELECT level, count(*) FILTER (f = level OR s = level)::BIGINT AS in_any, count(*) FILTER (f = level AND s = level)::BIGINT AS in_all, count(*) FILTER (f = level)::BIGINT AS first, count(*) FILTER (s = level)::BIGINT AS second
        FROM r, (SELECT unnest(['High', 'Med', 'Low']) AS level) GROUP BY level""",
    "mix_in_ranges": """
        WITH c AS (SELECT r_name AS region, r_regionkey AS n, count(c_custkey)::BIGINT AS delivered FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
        b AS (SELECT *, CASE WHEN n < 4 THEN 20 * n + 10 END AS l, CASE WHEN n < 4 THEN 80 * n + 40 END AS h FROM c),
        t AS (SELECT region, delivered, coalesce(l, greatest(0, sum(delivered) OVER () - sum(h) OVER ()))::BIGINT AS lo, coalesce(h, greatest(0, sum(delivered) OVER () - sum(l) OVER ()))::BIGINT AS hi FROM b)
        SELECT region, lo, hi, delivered, CASE WHEN delivered < lo THEN delivered - lo WHEN delivered > hi THEN delivered - hi ELSE 0 END::BIGINT AS gap FROM t""",
    "valued_cells": """
        SELECT CASE WHEN p_size % 5 > 0 THEN p_brand END AS value, CASE WHEN p_size % 5 > 1 THEN ['High', 'Med', 'Low'][p_size % 3 + 1] END AS confidence, count(*)::BIGINT AS parts FROM part GROUP BY ALL""",
    "staff_ranges": """
        SELECT CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN false END AS is_estimate, CASE WHEN p_size % 3 = 1 AND p_size % 2 = 0 THEN 'FTE, latest count' END AS note, count(*)::BIGINT AS parts,
          sum(CASE WHEN p_size % 3 < 2 THEN p_size END)::BIGINT AS lo, sum(CASE WHEN p_size % 3 = 0 THEN p_size + 10 WHEN p_size % 3 = 1 THEN p_size END)::BIGINT AS hi FROM part GROUP BY ALL""",
    "other_names": "SELECT s_suppkey, unnest(['Old ' || s_suppkey, 'Older']) AS alias FROM supplier WHERE s_suppkey % 2 = 0",
    "open_entries": "SELECT o_orderkey, o_orderkey BETWEEN 56 AND 60 AS weak FROM orders WHERE o_orderstatus = 'O'",
    "enriched_customers": "SELECT c_custkey, c_name, s_name AS contact FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "refreshed_orders": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
        UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 = 0""",
    "nations_by_table": "SELECT r_name AS section, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey",
}
