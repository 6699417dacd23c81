"""Log sources: text files with line numbers, header formats, CSV tables of scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sawmill.functions.regexes import Header, compile_format, java
from sawmill.functions.text import strip
from sawmill.plans.tables import saved


_MARK = "\x01"
#: Splits of files whose line counts are broadcast, some 100 bytes each.
SPLITS = 500_000


def read_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(path, line_no, value) of text files; line numbers start at 1 in each file.

    A file's splits are ordered by where they begin, so only counts of lines by split are gathered, not lines.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), "value")
    parts = rows.groupBy("path", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = saved(parts.select("path", "_split", "_first", before.alias("_before")), "splits")
    # up to SPLITS rows go to every task, so that no line is shuffled
    parts = F.broadcast(parts) if parts.count() <= SPLITS else parts
    rows = rows.join(parts, ["path", "_split"]).select("path", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line_no"), strip(F.col("value")).alias("value"))
    return rows if limit is None else rows.where(F.col("line_no") <= limit)


def parse_header(lines: DataFrame, header: str | Header, drop_unmatched: bool = False) -> DataFrame:
    """lines(value, ...) with a column for each field of the format; null where the line doesn't match, or its optional part is absent."""
    h = compile_format(header) if isinstance(header, str) else header
    pattern = java(h.pattern)
    # One match for each line: the fields come as one text with marks between, and a mark before it says that there was a match.
    # Lines that hold a mark themselves are matched field by field. Without a match there is no part k + 1, and get gives null.
    marked = F.split(F.regexp_replace("value", pattern, _MARK + _MARK.join(f"${g}" for g in h.groups)), _MARK, -1)
    slow = F.when(F.col("value").rlike(pattern), F.array(F.lit(""), *(F.regexp_extract("value", pattern, g) for g in h.groups)))
    rows = lines.where(F.col("value").rlike(pattern)) if drop_unmatched else lines
    rows = rows.withColumn("_parts", F.when(F.col("value").contains(_MARK), slow).otherwise(marked))
    fields = []
    for k, field in enumerate(h.fields):
        got = F.get("_parts", F.lit(k + 1))
        fields.append((F.nullif(got, F.lit("")) if field in h.optional else got).alias(field))
    return rows.select(*lines.columns, *fields)


def read_scored(spark: SparkSession, path: str, fill: bool = False) -> DataFrame:
    """A CSV table of templates, all columns as strings; with ``fill``, nulls are empty."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.fillna("") if fill else rows


def write_csv(rows: DataFrame, path: str) -> None:
    """A table as CSV files that replace those there."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
