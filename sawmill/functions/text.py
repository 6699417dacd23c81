"""Per-line text rules: reserved characters, masks, wildcards, tokens. All stay in the JVM."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.functions.regexes import java
from sawmill.sources.presets import NEEDED

# The wildcard and the patterns of tokens, touching words, neighbouring wildcards and placeholders, in Python's dialect.
WILDCARD = "<*>"
TOKEN = r"[\w\-\\/.]+|\(?<\*>\)?|\W"
SIMPLE_TOKEN = r"\w+|<\*>|\W"
TOUCHING = r"([\w.-]+)?<\*>([\w.-]+)?"
NEIGHBOURS = r"<\*>([\s.\-\\/]*<\*>)*"
PLACEHOLDER_RULE = r"(<<(.*?)>>)+|(<(.*?)>)+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, java(r"\A\s+|\s+\Z").replace(r"\Z", r"\z"), "")


def escape_reserved(c: Column) -> Column:
    """< > { } as full-width signs, so that wildcards and marks are never user text."""
    return F.translate(c, "<>{}", "＜＞｛｝")


def restore_reserved(c: Column) -> Column:
    return F.translate(F.replace(c, F.lit("{V}"), F.lit("")), "＜＞｛｝", "<>{}")


def has_word(c: Column) -> Column:
    """Whether an ASCII letter is left outside wildcards."""
    return F.replace(c, F.lit(WILDCARD), F.lit("")).rlike("[a-zA-Z]")


def has_letter(c: Column) -> Column:
    return c.rlike("[a-zA-Z]")


def one_word(c: Column) -> Column:
    """Fewer than two words."""
    return ~c.rlike(java(r"\w\W++\w"))


def is_word_token(c: Column) -> Column:
    return c.rlike("[a-zA-Z]") | (c == WILDCARD)


def _replaced(df: DataFrame, column: str, pattern: str, maybe: Column | None = None) -> DataFrame:
    """The column with the matches replaced by a wildcard, where a letter remains; the pattern is tried only where ``maybe`` holds."""
    old, new = F.col(column), F.regexp_replace(column, F.lit(pattern), F.lit(WILDCARD))
    df = df.withColumn(_NEW, new if maybe is None else F.when(maybe, new).otherwise(old))
    new = F.col(_NEW)
    return df.withColumn(column, F.when((new != old) & ~has_word(new), old).otherwise(new)).drop(_NEW)


_NEW = "new text of a mask"


def _worked_out(df: DataFrame, column: str) -> DataFrame:
    """df with the column behind a generator of one row, through which no filter is pushed down.

    A filter that were pushed through a chain of masks would hold the step before each of them several times, and double that again and again.
    """
    return df.select(*(c for c in df.columns if c != column), F.inline(F.array(F.struct(F.col(column))))).select(*df.columns)


def _needed(c: Column, pattern: str) -> Column | None:
    pieces, times = NEEDED.get(pattern, ((), 0))
    found = [F.contains(c, F.lit(x)) if times == 1 else F.substring_index(c, x, times) != c for x in pieces]
    return reduce(operator.or_, found) if found else None


def mask(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """The column with the matches of each pattern in turn replaced by a wildcard, where a letter remains."""
    for p in patterns:
        df = _replaced(df, column, java(p), _needed(F.col(column), p))
    return _worked_out(df, column) if patterns else df


#: TOUCHING for Java: a word is taken from its beginning or not at all, so that no word is read twice.
_TOUCHING = java(r"(?:(?<![\w.-])[\w.-]++)?<\*>(?:[\w.-]++)?")


def collapse_wildcards(df: DataFrame, column: str) -> DataFrame:
    """Wildcards take the word that touches them, where a letter remains; wildcards with only space and . - / \\ between are one."""
    wild = F.contains(F.col(column), F.lit(WILDCARD))
    df = _replaced(df, column, _TOUCHING, wild)
    return _worked_out(df.withColumn(column, F.when(wild, F.regexp_replace(column, F.lit(java(NEIGHBOURS)), F.lit(WILDCARD))).otherwise(F.col(column))), column)


def preprocess(df: DataFrame, column: str, dataset_masks: Sequence[str], shared_masks: Sequence[str]) -> DataFrame:
    """Reserved characters, the masks of the dataset, the shared masks, wildcards."""
    df = df.withColumn(column, escape_reserved(F.col(column)))
    return collapse_wildcards(mask(mask(df, column, dataset_masks), column, shared_masks), column)


def normalize_placeholders(c: Column) -> Column:
    """<<x>> and <x>, and runs of them, as one wildcard."""
    return F.regexp_replace(c, java(PLACEHOLDER_RULE), WILDCARD)


def tokens(c: Column) -> Column:
    """Words with - \\ / . in them, wildcards, single other signs; joined again they are the text."""
    return F.regexp_extract_all(c, F.lit("(?s)" + java(TOKEN)), F.lit(0))


def simple_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)" + java(SIMPLE_TOKEN)), F.lit(0))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(java(r"\w+")), F.lit(0))
