"""Lines and templates: first match, containment, the structured log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.functions.regexes import SPACES, java, template_pattern_column
from sawmill.functions.text import WILDCARD, restore_reserved
from sawmill.functions.text import words as words_of
from sawmill.plans.tables import hot_join, saved

#: Up to so many templates go to every task; beyond that texts and templates meet by a shuffle on their words.
BLOCK = 2000
#: Up to so many templates are tried one after the other in one expression, with patterns that are compiled once for a task.
FEW = 64
#: Stands for a wildcard and the white space after it, which the wildcard takes; no character of a text.
_GAP = "\x01"
_WORD = java(r"\w")[len("(?d)") :]
#: Words of a template that stand alone in each text that it matches: no wildcard, and no space that one takes, touches them.
_ALONE = f"(?<![{_WORD[1:-1]}{_GAP}]){_WORD}+(?![{_WORD[1:-1]}{_GAP}])"


def _rules(templates: DataFrame) -> DataFrame:
    """Templates with their pattern, and the longest piece between wildcards, in two passes: 1 with the text as it is, 2 with the marks {V} left out (only where there are some)."""

    def rule(rows: DataFrame, text: Column, number: int) -> DataFrame:
        pieces = F.split(text, r"(?:<\*>[" + SPACES["java"] + "]*)+", -1)
        longest = F.reduce(pieces, F.lit(""), lambda s, x: F.when(F.length(x) > F.length(s), x).otherwise(s))
        gaps = F.regexp_replace(text, r"<\*>[" + SPACES["java"] + "]*", _GAP)
        return rows.select("*", F.lit(number).alias("pass"), template_pattern_column(text).alias("pattern"), longest.alias("piece"), F.array_distinct(F.regexp_extract_all(gaps, F.lit(_ALONE), F.lit(0))).alias("words"))

    bare = F.replace(F.col("template_text"), F.lit("{V}"), F.lit(""))
    return rule(templates, F.col("template_text"), 1).unionByName(rule(templates.where(F.col("template_text").contains("{V}")), bare, 2))


def _index(rules: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, word, rules): templates under the word of theirs that the fewest templates have, or under none if they have no word that stands alone."""
    key = ["template_id", "pass"]
    each = rules.select(*scope, *key, F.explode("words").alias("word"))
    rare = each.groupBy(*scope, "word").agg(F.count("*").alias("n"))
    best = each.join(rare, [*scope, "word"]).groupBy(*key).agg(F.min(F.struct("n", "word")).alias("best")).select(*key, "best.word")
    rows = rules.drop("words").join(best, key, "left").withColumn("word", F.coalesce("word", F.lit("")))
    # templates under one word: as many as have no rarer one
    return rows.groupBy(*scope, "word").agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in (*scope, "word")))).alias("rules"))


def _met(texts: DataFrame, text: str, templates: DataFrame, scope: list[str]) -> DataFrame:
    """texts with a struct ``rule`` for each template that matches: an equi-join on words, then the longest piece, then the pattern."""
    small = len(templates.select("template_id").take(BLOCK + 1)) <= BLOCK
    index = saved(_index(_rules(templates), scope), "index")
    words = F.array_append(F.array_distinct(words_of(F.col(text))), F.lit(""))
    rows = texts.withColumn("word", F.explode(words))
    key = [*scope, "word"]
    if small:
        rows = rows.join(F.broadcast(index), key)
    else:
        known = rows.groupBy(*key).agg(F.count("*").alias("n")).join(index, key)
        rows = hot_join(rows, saved(known, "index"), key).drop("n")
    rows = rows.select(*texts.columns, F.explode("rules").alias("rule"))
    return rows.where(F.contains(F.col(text), F.col("rule.piece"))).where(F.expr(f"{text} rlike rule.pattern"))


def _by_turns(text: Column, templates: DataFrame) -> Column:
    """A struct (template_id, pass) of the first of at most FEW templates that matches, or null: no join and no shuffle."""
    kind = templates.schema["template_id"].dataType
    found = F.lit(None).cast(f"struct<template_id: {kind.simpleString()}, pass: int>")
    for r in reversed(_rules(templates).orderBy("pass", "ord", "template_id").select("template_id", "pass", "pattern", "piece").collect()):
        hit = F.contains(text, F.lit(r.piece)) & text.rlike(r.pattern)
        found = F.when(hit, F.struct(F.lit(r.template_id).cast(kind).alias("template_id"), F.lit(r["pass"]).alias("pass"))).otherwise(found)
    return found


def with_first_match(rows: DataFrame, text: str, templates: DataFrame) -> DataFrame:
    """rows that a template matches, with template_id and pass as first_match gives them.

    A few templates are tried on the rows where they are; with more, the distinct texts are matched and joined, hot ones by broadcast.
    """
    if len(templates.select("template_id").take(FEW + 1)) <= FEW:
        hit = F.inline(F.array(_by_turns(F.col(text), templates.select("template_id", "template_text", "ord"))))
        return rows.select("*", hit).where("pass is not null")
    found = first_match(rows.select(F.col(text).alias("text")), templates).withColumnRenamed("text", text)
    return hot_join(rows, saved(rows.groupBy(text).agg(F.count("*").alias("n")).join(found, text), "matched"), text).drop("n")


def first_match(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """(text, template_id, pass) for each distinct text: the first template (by ord) that matches it, of pass 1 if there is one.

    texts(text), templates(template_id, template_text, ord). Only distinct texts are matched, in one pass whatever the number of templates, and each only with the templates
    under one of its words, or under none (those without a literal word that stands alone). Texts that nothing matches are absent.
    """
    if len(templates.select("template_id").take(FEW + 1)) <= FEW:
        return with_first_match(texts.select("text").distinct(), "text", templates)
    hit = _met(texts.select("text").distinct(), "text", templates.select("template_id", "template_text", "ord"), [])
    best = hit.groupBy("text").agg(F.min(F.struct("rule.pass", "rule.ord", "rule.template_id")).alias("best"))
    return best.select("text", F.col("best.template_id").alias("template_id"), F.col("best.pass").alias("pass"))


def containment(templates: DataFrame) -> DataFrame:
    """(coverer_id, covered_id) of templates whose pattern matches another template's text; equal texts don't count.

    Where templates have a dataset, only those of one dataset are compared; an equi-join on it and on a literal word, as in first_match.
    """
    scope = ["dataset"] if "dataset" in templates.columns else []
    texts = templates.select(*scope, F.col("template_id").alias("covered_id"), F.col("template_text").alias("text"))
    # without a wildcard a template covers nothing but itself
    rules = templates.where(F.col("template_text").contains(WILDCARD)).select(*scope, "template_id", "template_text")
    hit = _met(texts, "text", rules, scope).where("rule.pass = 1 and text <> rule.template_text")
    return hit.select(F.col("rule.template_id").alias("coverer_id"), "covered_id").distinct()


def last_coverer(templates: DataFrame) -> DataFrame:
    """(covered_id, coverer_id): of the templates that cover one, the last by ord."""
    order = templates.select(F.col("template_id").alias("coverer_id"), "ord")
    return containment(templates).join(order, "coverer_id").groupBy("covered_id").agg(F.max_by("coverer_id", "ord").alias("coverer_id"))


def match_all(texts: DataFrame, templates: DataFrame, by: list[str]) -> DataFrame:
    """(by, template_id, every): whether a template matches all texts of its group; texts(by, text), templates(by, template_id, template_text)."""
    rules = templates.select(*by, "template_id", template_pattern_column(F.col("template_text")).alias("pattern"))
    return texts.select(*by, "text").distinct().join(rules, by).groupBy(*by, "template_id").agg(F.bool_and(F.expr("text rlike pattern")).alias("every"))


def structured(lines: DataFrame, samples: DataFrame, templates: DataFrame) -> DataFrame:
    """lines(sample_id, ...) with EventId and EventTemplate by way of samples(sample_id, template_id, log_num) and templates.

    One join of the lines, in which samples that many lines have are broadcast; lines without a sample stay as they are. Without log_num, lines are counted first.
    """
    names = templates.select("template_id", restore_reserved(F.col("template_text")).alias("EventTemplate"))
    of = samples.select("template_id").groupBy("template_id").agg(F.count("*").alias("n")).join(names, "template_id")
    named = hot_join(samples, saved(of, "names"), "template_id", how="left")
    if "log_num" not in samples.columns:
        named = named.join(lines.groupBy("sample_id").agg(F.count("*").alias("log_num")), "sample_id")
    named = saved(named.select("sample_id", F.col("template_id").alias("EventId"), "EventTemplate", "log_num"), "named")
    found = hot_join(lines.where("sample_id is not null"), named, "sample_id", "log_num", "left").drop("log_num")
    nulls = lines.where("sample_id is null").select("sample_id", *(c for c in lines.columns if c != "sample_id"), F.lit(None).cast(named.schema["EventId"].dataType).alias("EventId"), F.lit(None).cast("string").alias("EventTemplate"))
    return found.unionByName(nulls)


def occurrences(structured_log: DataFrame) -> DataFrame:
    """(EventTemplate, Occurrences, first_line): the template table; order it by Occurrences descending, then first_line."""
    return structured_log.where("EventTemplate is not null").groupBy("EventTemplate").agg(F.count("*").alias("Occurrences"), F.min("line_no").alias("first_line"))
