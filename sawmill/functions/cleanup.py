"""Template cleanup: scalar rules, applied to distinct templates and joined back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.functions.regexes import java
from sawmill.functions.text import strip

# Fixed values of the cleanup rules.
PATH_DELIMITERS = r"\s,!;:=|\"'\[\](){}"
TOKEN_DELIMITERS = PATH_DELIMITERS + r".\-+@#$%&"
CONSTANTS = ("true", "false", "null", "root", "admin")


def spaces(c: Column) -> Column:
    return F.regexp_replace(strip(c), java(r"\s+"), " ")


def _pieces(c: Column, delimiters: str) -> Column:
    return F.regexp_extract_all(c, F.lit(java(f"[{delimiters}]|[^{delimiters}]+")), F.lit(0))


def paths(c: Column) -> Column:
    """Pieces between path delimiters that are paths in whole become wildcards."""
    return F.array_join(F.transform(_pieces(c, PATH_DELIMITERS), lambda t: F.when(t.rlike("^(/[^/]+)+$"), "<*>").otherwise(t)), "")


def constants(c: Column, user_strings: Sequence[str] = ()) -> Column:
    """Truth values, common user names and user strings between token delimiters become wildcards, in any case."""
    known = sorted({s.lower() for s in (*CONSTANTS, *user_strings)})
    return F.array_join(F.transform(_pieces(c, TOKEN_DELIMITERS), lambda t: F.when(F.lower(t).isin(known), "<*>").otherwise(t)), "")


def dotted(c: Column) -> Column:
    return F.regexp_replace(c, r"<\*>(\.<\*>)+", "<*>")


def consecutive(c: Column) -> Column:
    return F.regexp_replace(c, r"(<\*>){2,}", "<*>")


def hashed(c: Column) -> Column:
    """#<*># becomes <*> as long as there is one: at most once for every two signs #."""
    passes = F.greatest(F.lit(1), (F.regexp_count(c, F.lit("#")) / 2).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), passes), c, lambda t, _: F.replace(t, F.lit("#<*>#"), F.lit("<*>")))


def colons(c: Column) -> Column:
    return F.regexp_replace(c, r"<\*>(:<\*>)+", "<*>")


def cleaned(df: DataFrame, column: str, user_strings: Sequence[str] = ()) -> DataFrame:
    """The column after all rules, one projection for each so that no rule is worked out twice."""
    for rule in (spaces, paths, lambda c: constants(c, user_strings), dotted, consecutive, hashed, colons):
        df = df.withColumn(column, rule(F.col(column)))
    return df


def post_process(structured: DataFrame, user_strings: Sequence[str] = ()) -> DataFrame:
    """Rows with EventTemplate cleaned. The rules run on distinct templates, of which there are few."""
    distinct = structured.select(F.coalesce("EventTemplate", F.lit("nan")).alias("_raw")).distinct().withColumn("_new", F.col("_raw"))
    new = cleaned(distinct, "_new", user_strings)
    return structured.withColumn("_raw", F.coalesce("EventTemplate", F.lit("nan"))).join(new, "_raw").withColumn("EventTemplate", F.col("_new")).drop("_raw", "_new")
