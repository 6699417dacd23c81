"""Interaction audit of filters: how much each filter of a chain removes, in every order of the filters.

Each row has a failure flag for each filter, and a part. CUBE over the flags and the part counts the rows for every choice of flags; its rows in which all chosen flags are
false are the survivors of that subset of the filters. A step of an order is a pair of subsets, the filters before it with and without its own, so all of
its figures come from a join of pairs of subsets, of which there are 2^k for each part. The rows themselves are counted once, by flags and part; CUBE runs on these counts.

What is the same text is told by SHA-256. The smallest doc_id of each text comes from a grouped minimum that tasks compute beforehand, and goes back to the rows by a join in
which hot texts are broadcast (``hot_join``), so a text that a third of the rows hold stays where it is.

Defined cases: null text is the empty text, null lang the part of the empty string; a null doc_id has no label, is never the smaller one and never fails E;
rows of one doc_id and text don't fail E for each other; several labels of one doc_id count as good (toxic) if one of them is; documents without
a label count as neither; a part all of whose rows fail has rows of zeros; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.llm.common import hot_join, saved

_WORD = r"[^\x20\x09-\x0D]+"
#: The filters of ``flagged``, by letter; orders of k filters are k!.
FILTERS = "ABCDE"


def flagged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of each document: whether it fails each filter, and what it is labelled (long, 0 or 1).

    A: fewer than 200 words. B: fewer than half of the words differ. C: over 3 in 100 characters are A-Z. D: a character of # $ % & * |. E: the text is that of a smaller doc_id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    rows = rows.select(
        "doc_id", "part", (F.size(words) < 200).alias("A"), (100 * F.size(F.array_distinct(words)) < 50 * F.size(words)).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.length("text")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"), F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    rows = saved(rows, "flags")
    named = rows.where("doc_id is not null")
    firsts = saved(named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    named = hot_join(named, firsts, "digest", how="left").select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))
    one = lambda c: F.max((F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1).cast("long"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    known = saved(rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(known, "doc_id"), "labels")
    named = hot_join(named, known, "doc_id", how="left").select("part", *FILTERS, "good", "toxic")
    nameless = rows.where("doc_id is null").select("part", *"ABCD", F.lit(False).alias("E"), F.lit(None).cast("long").alias("good"), F.lit(None).cast("long").alias("toxic"))
    return named.unionByName(nameless).fillna(0, ["good", "toxic"])


def survivors(rows: DataFrame, filters: str, measures: list[str]) -> DataFrame:
    """(part, subset, n, measures) for every part and subset of the filters: the rows of which no flag of the subset is set, and sums of measures.

    ``filters``: one letter for each flag column; subset has bit k for the k-th of them. Zeros included.
    """
    cells = saved(rows.groupBy("part", *filters).agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in measures)), "cells")  # 2^k for each part
    cube = cells.cube(*filters, "part").agg(*(F.sum(c).alias(c) for c in ("n", *measures)), F.grouping("part").alias("_all"), *(F.grouping(f).alias(f"_{f}") for f in filters))
    passed = cube.where("_all = 0")
    for f in filters:
        passed = passed.where((F.col(f"_{f}") == 1) | ~F.col(f))
    subset = sum((F.when(F.col(f"_{f}") == 0, 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    passed = passed.select("part", subset.alias("subset"), "n", *measures)
    every = cells.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))))
    return every.join(passed, ["part", "subset"], "left").fillna(0, ["n", *measures])


def interactions(rows: DataFrame, filters: str = FILTERS, measures: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """One row for each part, order of the filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails, <measure>_lost, shapley).

    rows(part, a flag for each filter, measures). kept: after the step; removed: by it; redundant: fails its filter but is gone before; unique_fails: fails no other
    filter; <measure>_lost: sum over what it removes; shapley: what its filter removes, summed over all orders.
    """
    measures, k = list(measures), len(filters)
    whole = (1 << k) - 1
    left = saved(survivors(rows, filters, measures), "survivors")
    # pairs of subsets: without a filter, and with it
    pair = left.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("subset & shiftleft(1, filter) = 0").withColumn("with", F.expr("subset + shiftleft(1, filter)"))
    after = left.select("part", F.col("subset").alias("with"), F.col("n").alias("kept"), *(F.col(m).alias(f"_{m}") for m in measures))
    weight = F.element_at(F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k))), F.bit_count("subset") + 1)
    pair = pair.join(after, ["part", "with"]).select("part", "subset", "filter", "kept", (F.col("n") - F.col("kept")).alias("removed"), *((F.col(m) - F.col(f"_{m}")).alias(f"{m}_lost") for m in measures), weight.alias("weight"))
    pair = saved(pair, "pairs")
    alone = lambda s: F.sum(F.when(F.col("subset") == s, F.col("removed")).otherwise(0))
    of = pair.groupBy("part", "filter").agg(alone(0).alias("fails"), alone(F.lit(whole) - F.call_function("shiftleft", F.lit(1), F.col("filter"))).alias("unique_fails"), F.sum(F.col("weight") * F.col("removed")).alias("shapley"))
    orders = F.array(*(F.lit("".join(o)) for o in permutations(filters)))
    steps = left.select("part").distinct().select("part", F.explode(orders).alias("filter_order")).select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    before = sum((F.when(F.locate(f, F.expr("substring(filter_order, 1, step - 1)")) > 0, 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    own = F.expr(f"instr('{filters}', substring(filter_order, step, 1)) - 1")
    steps = steps.withColumn("subset", before).withColumn("filter", own)
    out = steps.join(pair, ["part", "subset", "filter"]).join(of, ["part", "filter"])
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *(f"{m}_lost" for m in measures), "shapley")


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions of the five filters of ``flagged``, by lang."""
    return interactions(flagged(documents, labels))
