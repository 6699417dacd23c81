"""Templates from a language model that the user supplies, asked once for each prompt.

A provider is a function from a prompt to an answer; it runs in tasks, on prompts that the cache table does not hold. Without one a
template is the text itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sawmill.functions import text as T
from sawmill.functions.regexes import template_pattern
from sawmill.operators import lcs
from sawmill.operators.model import asked

PROMPT = "Replace the variable parts of this log message by <<placeholders>> and give the result between backticks: `{}`"
_SPAN = re.compile(r"`+([^`]+)`+")
_TOUCHING, _NEIGHBOURS = re.compile(T.TOUCHING), re.compile(T.NEIGHBOURS)


def prompt_of(content: str) -> str:
    return PROMPT.format(content.replace("<*>", "<<preprocessed>>"))


@lru_cache(1 << 14)
def matcher(template: str) -> Callable[[str], re.Match | None]:
    """What tells whether a template matches a text, compiled once."""
    return re.compile(template_pattern(template, "java")[len(r"\A(?:") : -len(r")\z")]).fullmatch


def collapsed(template: str) -> str:
    """functions.text.collapse_wildcards for one text."""
    taken = _TOUCHING.sub(T.WILDCARD, template)
    template = taken if re.search("[a-zA-Z]", taken.replace(T.WILDCARD, "")) else template
    return _NEIGHBOURS.sub(T.WILDCARD, template)


def answered(content: str, answer: str) -> str:
    """The template of an answer: the one span between backticks or the whole, made to match the content, or the content itself."""
    spans = _SPAN.findall(answer)
    template = lcs.PLACEHOLDER.sub(T.WILDCARD, spans[0] if len(spans) == 1 else answer)
    if matcher(template)(content) is None:
        template = lcs.repaired(content, template)
    if matcher(template)(content) is None or not re.search("[a-zA-Z]", template.replace("<*>", "")):
        template = content
    return collapsed(template)


def extract(texts: DataFrame, provider: Callable[[str], str] | None = None, cache: DataFrame | None = None, report: dict | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(templates(content, template), cache(prompt, answer) with the new answers) of texts(content).

    Only prompts that the cache lacks are asked (``model.asked``, which takes the options). A text whose prompt fails is its own template; the failure isn't cached, so a later run asks
    again. ``report`` takes the counters of the run, and the failed prompts as a table under the name failures.
    """
    rows = texts.select("content").distinct()
    prompts = rows.withColumn("prompt", F.concat(F.lit(PROMPT.split("{}")[0]), F.replace(F.col("content"), F.lit("<*>"), F.lit("<<preprocessed>>")), F.lit(PROMPT.split("{}")[1])))
    empty = prompts.sparkSession.createDataFrame([], "prompt string, answer string")
    known = empty if cache is None else cache.select("prompt", "answer").dropDuplicates(["prompt"])
    if provider is None:
        return rows.select("content", F.col("content").alias("template")), known
    found, counters = asked(prompts.select("prompt").join(known, "prompt", "left_anti"), provider, **options)
    if report is not None:
        report |= counters | {"failures": found.where("answer is null")}
    every = known.union(found.where("answer is not null").select("prompt", "answer"))
    finish = F.pandas_udf(lambda c, a: pd.Series([x if y is None else answered(x, y) for x, y in zip(c, a)]), StringType())
    return prompts.join(every, "prompt", "left").select("content", finish("content", "answer").alias("template")), every
