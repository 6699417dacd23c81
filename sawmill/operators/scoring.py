"""Scores of a parse against the truth. Everything comes from one table of (dataset, truth, parsed, n)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sawmill.functions.cleanup import post_process
from sawmill.functions.text import words
from sawmill.sources.logs import write_csv


def pair_table(lines: DataFrame, parsed_only: bool = False) -> DataFrame:
    """(dataset, truth, parsed, n) of lines(dataset, truth, parsed). Small: templates, not lines.

    A null parse counts as empty; with ``parsed_only``, lines without a parse are left out, on both sides.
    """
    lines = lines.where("parsed is not null") if parsed_only else lines
    return lines.select("dataset", "truth", F.coalesce("parsed", F.lit("")).alias("parsed")).groupBy("dataset", "truth", "parsed").agg(F.count("*").alias("n"))


def aligned(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """(dataset, truth, parsed) of the lines that both tables (dataset, LineId, EventTemplate) have."""
    rows = truth.select("dataset", "LineId", F.col("EventTemplate").alias("truth"))
    return rows.join(parsed.select("dataset", "LineId", F.col("EventTemplate").alias("parsed")), ["dataset", "LineId"]).select("dataset", "truth", "parsed")


def evaluate(truth: DataFrame, parsed: DataFrame, user_strings: Sequence[str] = (), only: Sequence[str] | None = None, parsed_only: bool = False) -> DataFrame:
    """Scores of a parse: its templates are cleaned, its lines aligned with those of the truth, and each dataset gets its row of scores.

    With ``parsed_only``, lines that have no parse don't count on either side; else their template is empty.
    """
    parsed = parsed.where("EventTemplate is not null") if parsed_only else parsed
    return scores(pair_table(aligned(truth, post_process(parsed, user_strings))), only)


def write_reports(pairs: DataFrame, path: str, only: Sequence[str] | None = None) -> None:
    """CSV tables in three folders of ``path``, each replacing what is there: grouping_errors (dataset, kind, anchor, other, n), parse_errors (dataset, truth, parsed, n) and scores.

    A grouping error is a split (a parsed template, its anchor, that holds lines of several truths) or a merge (a truth with lines of several parsed templates).
    """
    split = split_errors(pairs).select("dataset", F.lit("split").alias("kind"), F.col("parsed").alias("anchor"), F.col("truth").alias("other"), "n")
    merge = merge_errors(pairs).select("dataset", F.lit("merge").alias("kind"), F.col("truth").alias("anchor"), F.col("parsed").alias("other"), "n")
    # a null truth has no name in a CSV file, where an empty text is quoted
    write_csv(split.unionByName(merge), f"{path}/grouping_errors")
    write_csv(parse_errors(pairs), f"{path}/parse_errors")
    write_csv(scores(pairs, only), f"{path}/scores")


def sized(pairs: DataFrame) -> DataFrame:
    """Pairs with the lines and the number of partners of their truth (tn, tk) and their parse (pn, pk)."""
    t, p = Window.partitionBy("dataset", "truth"), Window.partitionBy("dataset", "parsed")
    return pairs.withColumn("tn", F.sum("n").over(t)).withColumn("tk", F.count("*").over(t)).withColumn("pn", F.sum("n").over(p)).withColumn("pk", F.count("*").over(p))


def _over(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def _harmonic(a: Column, b: Column) -> Column:
    return F.when((a != 0) | (b != 0), 2 * (a * b) / (a + b)).otherwise(F.lit(0.0))


def _sum(cond: Column, value: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n") if value is None else value)), F.lit(0)).cast("long")


def scores(pairs: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """One row for each dataset: GA, FGA, PA, PTA, RTA, FTA, ED, UP, WLA, pair precision, recall and F1, counts of templates.

    ``only``: truth templates that GA, FGA, PA, PTA, RTA and FTA are restricted to.
    """
    rows = sized(pairs)
    same, lone = F.col("truth") == F.col("parsed"), F.col("tn") == 1
    within = F.lit(True) if only is None else F.coalesce(F.col("truth").isin(list(only)), F.lit(False))
    parsed_within = F.lit(True) if only is None else F.coalesce(F.col("parsed").isin(list(only)), F.lit(False))
    grouped = (F.col("tk") == 1) & (F.col("pn") == F.col("tn"))
    exact = same & (F.col("pk") == 1)
    two = lambda x: (F.col(x) * (F.col(x) - 1) / 2)
    a = rows.groupBy("dataset").agg(
        F.sum("n").cast("long").alias("lines"), _sum(within).alias("inside"), _sum(within & grouped).alias("grouped_lines"), _sum(within & grouped, F.lit(1)).alias("grouped_templates"),
        F.count_distinct(F.when(within, F.col("parsed"))).alias("tool"), (F.count_distinct("truth") if only is None else F.lit(len(set(only)))).alias("ground"),
        _sum(within & same).alias("same_lines"), _sum(exact & parsed_within, F.lit(1)).alias("exact"),
        F.sum(F.col("n") * F.levenshtein("truth", "parsed")).cast("long").alias("edits"), _sum(lone).alias("lone"), _sum(lone & same).alias("lone_same"),
        _sum(words(F.col("truth")) == words(F.col("parsed"))).alias("same_words"),
        F.sum(two("n")).cast("long").alias("pairs"), F.sum(two("tn") / F.col("tk")).alias("truth_pairs"), F.sum(two("pn") / F.col("pk")).alias("parsed_pairs"),
    )
    c = F.col
    a = a.withColumns({"PGA": _over(c("grouped_templates"), c("tool")), "RGA": _over(c("grouped_templates"), c("ground")), "PTA": _over(c("exact"), c("tool")), "RTA": _over(c("exact"), c("ground"))})
    a = a.withColumns({"pair_precision": _over(c("pairs"), F.round("parsed_pairs")), "pair_recall": _over(c("pairs"), F.round("truth_pairs"))})
    return a.select(
        "dataset", _over(c("grouped_lines"), c("inside")).alias("GA"), _harmonic(c("PGA"), c("RGA")).alias("FGA"), _over(c("same_lines"), c("inside")).alias("PA"), "PTA", "RTA", _harmonic(c("PTA"), c("RTA")).alias("FTA"),
        _over(c("edits"), c("lines")).alias("ED"), _over(c("lone_same"), c("lone")).alias("UP"), _over(c("same_words"), c("lines")).alias("WLA"),
        "pair_precision", "pair_recall", _harmonic(c("pair_precision"), c("pair_recall")).alias("pair_f1"), c("tool").cast("long").alias("tool_templates"), c("ground").cast("long").alias("ground_templates"),
    )


def grouping_from_parsed(pairs: DataFrame) -> DataFrame:
    """(dataset, GA) from the parsed side: lines of parsed templates that hold one truth only, and all of its lines."""
    good = (F.col("pk") == 1) & (F.col("tn") == F.col("pn"))
    return sized(pairs).groupBy("dataset").agg(_over(_sum(good), F.sum("n")).alias("GA"))


def split_errors(pairs: DataFrame) -> DataFrame:
    """(dataset, parsed, truth, n): parsed templates that hold lines of several truths."""
    return sized(pairs).where("pk <> 1").select("dataset", "parsed", "truth", "n")


def merge_errors(pairs: DataFrame) -> DataFrame:
    """(dataset, truth, parsed, n): truths whose lines have several parsed templates."""
    return sized(pairs).where("tk <> 1").select("dataset", "truth", "parsed", "n")


def parse_errors(pairs: DataFrame) -> DataFrame:
    """(dataset, truth, parsed, n): truths with several parses, or with a wrong one."""
    own = F.max(F.col("truth") == F.col("parsed")).over(Window.partitionBy("dataset", "truth"))
    return sized(pairs).withColumn("own", own).where("tk > 1 or not own").select("dataset", "truth", "parsed", "n")
