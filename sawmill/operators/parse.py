"""From files of log lines to the structured log and the table of templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.functions import text as T
from sawmill.functions.regexes import Header, compile_format
from sawmill.operators import match, mining
from sawmill.plans.tables import saved
from sawmill.sources.logs import parse_header, read_lines, write_csv
from sawmill.sources.presets import SHARED_MASKS


#: The masked content beside the header's own fields.
_CONTENT = "masked content"


def parse(lines: DataFrame, header: str | Header, masks: Sequence[str] = (), shared: Sequence[str] = SHARED_MASKS, drop_unmatched: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(structured log, templates) of lines(dataset, line_no, value).

    The structured log has dataset, LineId, the header's fields, EventId and EventTemplate; lines without a header match keep their row with nulls there. The
    templates table has dataset, EventTemplate, Occurrences and first_line. options: those of mining.mine.
    """
    h = compile_format(header) if isinstance(header, str) else header
    rows = parse_header(lines.select("dataset", "line_no", "value"), h, drop_unmatched).drop("value")
    content = F.col("Content") if "Content" in h.fields else F.lit(None).cast("string")
    rows = T.preprocess(rows.withColumn(_CONTENT, content), _CONTENT, masks, shared)
    # header fields and content are worked out once, and the lines are shuffled once, to meet their samples
    rows = saved(rows.withColumn("sample_id", F.when(F.col(_CONTENT).isNotNull(), F.xxhash64("dataset", _CONTENT))), "lines")
    samples, names = mining.mine(rows.select("dataset", "line_no", F.col(_CONTENT).alias("content")), **options)
    log = match.structured(rows.drop(_CONTENT), samples, names).withColumnRenamed("line_no", "LineId")
    log = log.select("dataset", "LineId", *h.fields, "EventId", "EventTemplate")
    found = log.where("EventTemplate is not null").groupBy("dataset", "EventTemplate").agg(F.count("*").alias("Occurrences"), F.min("LineId").alias("first_line"))
    return log, found


def parse_files(spark: SparkSession, path: str, header: str | Header, masks: Sequence[str] = (), limit: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """parse of text files: each file is a dataset, named by its path; of each the first ``limit`` lines, if given."""
    return parse(read_lines(spark, path, limit).withColumnRenamed("path", "dataset"), header, masks, **options)


def write_parse(log: DataFrame, templates: DataFrame, log_path: str, templates_path: str) -> None:
    """Both tables as CSV; templates with the most lines come first, of equals the one seen first."""
    write_csv(log, log_path)
    write_csv(templates.orderBy("dataset", F.desc("Occurrences"), "first_line").select("dataset", "EventTemplate", "Occurrences"), templates_path)
