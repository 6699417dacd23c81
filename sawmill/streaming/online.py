"""Log lines as a stream: parsed and masked as they come, samples counted in state, templates matched by micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sawmill.functions.text import preprocess
from sawmill.operators.match import first_match
from sawmill.plans.tables import hot_join, saved
from sawmill.sources.logs import parse_header


def contents(lines: DataFrame, header: str, dataset_masks: Sequence[str], shared_masks: Sequence[str]) -> DataFrame:
    """Streaming lines(value, ...) with header fields and content; lines without the header are dropped. No state."""
    rows = parse_header(lines, header, drop_unmatched=True)
    return preprocess(rows.withColumnRenamed("Content", "content"), "content", dataset_masks, shared_masks)


def sample_counts(rows: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Running (keys, content, log_num, first_line): one state row for each distinct text. Write with output mode update."""
    return rows.groupBy(*keys, "content").agg(F.count("*").alias("log_num"), F.min("line_no").alias("first_line"))


def windowed_templates(rows: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """(window, content, n): lines by masked text and tumbling window of event time; state of windows older than ``late`` goes."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), "content").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "content", "n")


def match_stream(rows: DataFrame, templates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes rows(content, ...) with template_id (null where nothing matches) as Parquet, each micro-batch once.

    The batch number is a partition of the table, and a repeated batch replaces its own files.
    """

    def one(batch: DataFrame, number: int) -> None:
        found = first_match(batch.select(F.col("content").alias("text")), templates).withColumnRenamed("text", "content")
        counted = batch.groupBy("content").agg(F.count("*").alias("_n")).join(found, "content")
        hot_join(batch, saved(counted, "matched"), "content", "_n", "left").drop("_n").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
