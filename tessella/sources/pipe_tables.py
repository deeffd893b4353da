"""Pipe tables in Markdown text, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cells(line: Column) -> Column:
    """The trimmed cells of a table line, without the outer pipes."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(c))


def _apart(names: Column) -> Column:
    """The names, those that came before with their number behind them."""

    def numbered(name: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: x == name))
        return F.when(before > 0, F.concat_ws(" ", name, (before + 1).cast("string"))).otherwise(name)

    return F.transform(names, numbered)


def parse_pipe_tables(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, section, cells): a map from header to cell for each data line of each table of each document.

    A table is a header line, a line of dashes and data lines; section is the last heading above.  Lines are
    numbered within their document, which is the unit that a task takes whole.  A line with more or fewer cells than its
    header has the cells that both have; of headers of one name the second is "name 2", the third "name 3".  A null text has
    no lines; repeated documents of one path are read as one, line beside line.
    """
    lines = documents.select(path, F.posexplode(F.split(text, r"\r?\n", -1)).alias("line", "_t"))
    row = F.col("_t").rlike(r"^\s*\|.*\|\s*$")
    rule = F.col("_t").rlike(r"^\s*\|(\s*:?-+:?\s*\|)+\s*$")
    order = W.partitionBy(path).orderBy("line")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("_rule", rule).withColumn("_row", row)
    lines = lines.withColumn("_header", F.coalesce(F.lead("_rule").over(order), F.lit(False)) & F.col("_row"))
    lines = lines.withColumn("section", F.last(F.when(F.col("_t").rlike("^#+ "), F.regexp_replace("_t", r"^#+\s*", "")), True).over(upto))
    lines = lines.withColumn("_names", F.last(F.when(F.col("_header"), F.col("_t")), True).over(upto))
    lines = lines.withColumn("_break", F.last(F.when(~F.col("_row"), F.col("line")), True).over(upto)).withColumn("_at", F.last(F.when(F.col("_header"), F.col("line")), True).over(upto))
    data = lines.where("_row and not _rule and not _header and _names is not null and _at > coalesce(_break, -1)")
    names, values = _apart(cells(F.col("_names"))), cells(F.col("_t"))
    n = F.least(F.size(names), F.size(values))
    return data.select(path, (F.col("line") + 1).alias("line"), "section", F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(values, F.lit(1), n)).alias("cells"))


def read_pipe_tables(spark: SparkSession, path: str) -> DataFrame:
    """parse_pipe_tables of the text files at path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_pipe_tables(files)
