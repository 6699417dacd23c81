"""Secret scans, in DataFrame functions only: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 12 or more key characters with a digit in it; or, without that, a run that begins with a known prefix of keys (12 or more
characters), or the run of any length that stands after the name of a secret and = or :. The forest (spark.ml) learns from labelled findings; ``findings.labelled``
makes those it takes by default, and a table of the same columns replaces them. Its features:

* length, shares of digits, upper-case and different characters, whether all is hexadecimal, whether a known prefix begins it;
* character transitions: changes of the kind of character, the mean odds of its pairs of neighbouring characters, and how likely its pairs of letters are
  in the words of the corpus;
* dictionary coverage: the share of its letters in words that stand alone in at least LEAST documents and in a SHARE of them;
* path: whether it or what touches it looks like one;
* neighbouring words: the odds of the word next before it, the sums of those of the NEAR words before it, after it, and of the words in it; whether = or : stands before it.

Odds are logarithms of how often labelled secrets and other findings have a word or pair of characters. They come from one half of the
labelled rows and the forest from the other, so that no row's own label is among its features.

Defined cases: null and empty texts have no candidates; a null doc_id is carried through; repeated rows give repeated findings;
runs are never cut, however long; an empty table gives no rows; labelled rows with null columns are left out; without labelled rows of both labels in each half every
score is the share of secrets among them (0.5 without rows); other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.llm.common import hot_join, saved, worked_out
from sawmill.llm.findings import labelled

PATTERN = r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/=.-]*+[0-9])[A-Za-z0-9_+/=.-]{12,}+"
CONTEXT = 32
#: A word of the dictionary stands in at least so many documents, and in this share of them.
LEAST, SHARE = 3, 1 / 2000
#: Neighbouring words on each side.
NEAR = 4
TREES, DEPTH, SEED = 32, 8, 7
#: Labelled findings that are made if none are given.
LABELLED = 6000
FEATURES = ["length", "digits", "uppers", "distinct", "hexadecimal", "prefixed", "changes", "pairs", "wordlike", "coverage", "pathlike", "assigned", "nearest_odds", "before_odds", "after_odds", "own_odds"]

_PREFIX = r"^(AKIA|ASIA|gh[pousr]_|xox[bap]-|sk_live_|sk-|AIza|eyJ)"
_NAMES = r"(?i)(pass(word|wd|phrase)?|secret|token|api[_ -]?key|auth|credential|private[_ -]?key)"
#: Runs of key characters after a prefix of keys, and those after a secret's name with = or : (the last group). What overlaps a run of PATTERN isn't proposed again.
_KEY = "[A-Za-z0-9_+/=.-]"
PREFIXED = rf"(?<![A-Za-z0-9_+/.-])(?={_PREFIX[1:]})({_KEY}{{12,}}+)"
NAMED = rf"{_NAMES}[\w-]*+[\"']?[ \t]*+[=:]++>?[ \t]*+[\"']?(?=({_KEY}++))"
#: A word that stands alone, not a part of a run of key characters.
_ALONE = r"(?<![A-Za-z0-9_+/=.-])[a-z]{3,}(?![A-Za-z0-9_+/=-])"


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, start, candidate, before, after) of each candidate; start counts code points, before and after are CONTEXT characters."""
    rows = worked_out(_texts(documents), base=_all(PATTERN)).where("size(base) > 0")
    return _around(worked_out(_placed(rows, PATTERN, "base", "base"), runs="base_runs"))


def all_candidates(documents: DataFrame) -> DataFrame:
    """candidates, and the runs of PREFIXED and NAMED that overlap none of them; each run once."""
    group = len(re.findall(r"\((?!\?)", NAMED))
    rows = worked_out(_texts(documents), base=_all(PATTERN), prefixed=_all(PREFIXED), named=_all(NAMED)).where("size(base) + size(prefixed) + size(named) > 0")
    rows = worked_out(rows, taken=f"if(size(named) > 0, {_all(NAMED, group)}, named)")
    rows = _placed(_placed(_placed(rows, PATTERN, "base", "base"), PREFIXED, "prefixed", "prefixed"), NAMED, "named", "taken")
    kind = lambda name, n: f"transform({name}_runs, r -> struct(r.start as start, {n} as kind, r.found as found))"
    rows = worked_out(rows, every=f"array_sort(concat({kind('base', 0)}, {kind('prefixed', 1)}, {kind('named', 1)}))")
    # where the runs of PATTERN before each place end, and where the next one begins
    rows = worked_out(rows, ends="transform(every, r -> if(r.kind = 0, r.start + length(r.found), -1))", firsts=f"transform(reverse(every), r -> if(r.kind = 0, r.start, {_FAR}))")
    rows = _running(_running(rows, "ends", "upto", "-1", "greatest(s, x)"), "firsts", "behind", str(_FAR), "least(s, x)")
    free = "upto[i] <= r.start and behind[size(every) - 1 - i] >= r.start + length(r.found) and (i = 0 or every[i - 1] <> r)"
    rows = worked_out(rows, marked=f"transform(every, (r, i) -> struct(r.start as start, r.found as found, r.kind = 0 or ({free}) as keep))")
    return _around(worked_out(rows, runs="filter(marked, r -> r.keep)"))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")


_FAR = 2147483647
#: Sums over many places go by groups of so many, and groups of groups.
_GROUP = 64
#: Texts are cut in pieces of so many characters, near which a context is looked up.
_PIECE = 256


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _all(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(text, {_sql(pattern)}, {group})"


def _running(rows: DataFrame, values: str, name: str, zero: str, join: str) -> DataFrame:
    """rows with an array of what ``join`` (of s and x) makes of all values before each place.

    A value is joined with those of its group, groups with those of theirs, so the work is in proportion to the number of values; only groups of groups are joined from the first on.
    """
    part = lambda a, start, n: f"aggregate(slice({a}, {start}, {n}), {zero}, (s, x) -> {join})"
    both = lambda a, b: f"aggregate(array({b}), {a}, (s, x) -> {join})"
    grouped = lambda a: f"transform(sequence(0, greatest(size({a}) - 1, 0) div {_GROUP}), k -> {part(a, f'cast(k * {_GROUP} + 1 as int)', _GROUP)})"
    within = lambda a, above: f"transform({a}, (v, i) -> {both(f'{above}[cast(i div {_GROUP} as int)]', part(a, f'cast((i div {_GROUP}) * {_GROUP} + 1 as int)', f'cast(i % {_GROUP} as int)'))})"
    rows = worked_out(worked_out(rows, _one=grouped(values)), _two=grouped("_one"))
    rows = worked_out(rows, _above=f"transform(_two, (v, i) -> {part('_two', '1', 'i')})")
    rows = worked_out(worked_out(rows, _upto=within("_one", "_above")), **{name: within(values, "_upto")})
    return rows.drop("_one", "_two", "_above", "_upto")


def _placed(rows: DataFrame, pattern: str, matched: str, taken: str) -> DataFrame:
    """rows with <matched>_runs: (start, found) of each match; where another group is taken, it is what a lookahead at the end of the match takes, and begins there."""
    rows = worked_out(rows, _gaps=f"if(size({matched}) > 0, transform(split(text, {_sql(pattern)}, -1), g -> length(g)), array())")
    rows = _running(worked_out(rows, _steps=f"transform({matched}, (m, i) -> _gaps[i] + length(m))"), "_steps", "_at", "0", "s + x")
    begin = "_at[i] + _gaps[i]" + (f" + length({matched}[i])" if taken != matched else "")
    return worked_out(rows, **{f"{matched}_runs": f"transform({taken}, (m, i) -> struct({begin} as start, m as found))"}).drop("_gaps", "_steps", "_at")


def _around(rows: DataFrame) -> DataFrame:
    """A row for each of runs, with what stands around it, looked up in the pieces of the text that are next to it."""
    rows = worked_out(rows.where("size(runs) > 0").select("doc_id", "text", "runs"), pieces=_all(f"(?s).{{1,{_PIECE}}}"))
    rows = rows.select("doc_id", "pieces", F.expr("inline(runs)")).selectExpr("doc_id", "pieces", "start", "found", f"cast(start div {_PIECE} as int) as k", "start + length(found) as stop")
    near = lambda k: f"concat(coalesce(get(pieces, {k}), ''), coalesce(get(pieces, {k} + 1), ''))"
    offset = f"if(k > 0, {_PIECE}, 0) + start % {_PIECE}"
    before = f"substring({near('greatest(k - 1, 0)')}, greatest({offset} - {CONTEXT}, 0) + 1, least({offset}, {CONTEXT}))"
    after = f"substring({near(f'cast(stop div {_PIECE} as int)')}, stop % {_PIECE} + 1, {CONTEXT})"
    return rows.selectExpr("doc_id", "start", "found as candidate", f"{before} as before", f"{after} as after")


def dictionary(documents: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(word) of three letters or more that stand alone in ``least`` documents or more, and in this share of them."""
    words = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(_ALONE), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= max(least, share * documents.count())).select("word")


def _pairs(text: Column) -> Column:
    """The pairs of neighbouring characters of a text, its ends marked by ^ and $."""
    return F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit("(?s)(?=(..))"), F.lit(1))


def _parts() -> dict[str, Column]:
    """What has odds, by kind: pairs of characters (digits as 0, signs as -) and words before, after and within a candidate."""
    lower = F.lower("candidate")
    letters = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{2,}"), F.lit(0))
    before = letters(F.col("before"))
    return {
        "pair": _pairs(F.regexp_replace(F.translate(lower, "123456789", "000000000"), "[^a-z0]", "-")),
        "nearest": F.slice(F.reverse(before), 1, 1),
        "before": F.slice(F.reverse(before), 1, NEAR),
        "after": F.slice(letters(F.col("after")), 1, NEAR),
        "own": F.regexp_extract_all(lower, F.lit("[a-z]{3,}"), F.lit(0)),
    }


def _exploded(rows: DataFrame, parts: dict[str, Column], *columns: str) -> DataFrame:
    """(columns, kind, part) for each part."""

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("part")))

    every = F.concat(*(named(kind, values) for kind, values in parts.items()))
    return rows.select(*columns, F.explode(every).alias("p")).select(*columns, "p.kind", "p.part")


def _odds(findings: DataFrame, words: DataFrame) -> DataFrame:
    """(kind, part, odds): the logarithm of the odds of a secret; for the kind letters, of a pair of letters in words against any pair.

    The rows are bounded by the labelled findings and by the pairs of letters.
    """
    many = F.sum(F.lit(1) * F.col("label")), F.sum(1 - F.col("label"))
    learned = _exploded(findings, _parts(), "label").groupBy("kind", "part").agg(F.log((many[0] + 1) / (many[1] + 1)).alias("odds"))
    pairs = words.select(F.explode(_pairs(F.col("word"))).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    first = pairs.groupBy(F.substring("part", 1, 1).alias("first")).agg(F.sum("n").alias("all"))
    likely = pairs.join(first, F.substring("part", 1, 1) == F.col("first")).select(F.lit("letters").alias("kind"), "part", F.log2((F.col("n") + 1) * 28 / (F.col("all") + 28)).alias("odds"))
    return learned.union(likely)


def _featured(rows: DataFrame, words: DataFrame, odds: DataFrame) -> DataFrame:
    """rows(row, candidate, before, after, ...) with FEATURES; row is a number of its own for each, odds a table of bounded size."""
    runs = F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]+"), F.lit(0))
    parts = _parts() | {"letters": F.flatten(F.transform(runs, _pairs))}
    found = _exploded(rows, parts, "row").join(F.broadcast(odds), ["kind", "part"], "left").groupBy("row").agg(
        F.avg(F.when(F.col("kind") == "pair", F.coalesce("odds", F.lit(0.0)))).alias("pairs"),
        F.avg(F.when(F.col("kind") == "letters", F.coalesce("odds", F.lit(-5.0)))).alias("wordlike"),
        *(F.sum(F.when(F.col("kind") == k, F.col("odds"))).alias(f"{k}_odds") for k in ("nearest", "before", "after", "own")),
    )
    inside = rows.select("row", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    known = inside.groupBy("word").agg(F.count("*").alias("n")).join(words, "word")
    cover = hot_join(inside, saved(known, "known"), "word").groupBy("row").agg(F.sum(F.length("word")).alias("covered"))
    c, size = F.col("candidate"), F.length("candidate").cast("double")
    count = lambda p: F.regexp_count(c, F.lit(p)) / size
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    letters = F.greatest(F.regexp_count(c, F.lit("[A-Za-z]")), F.lit(1))
    none = lambda x: F.coalesce(x, F.lit(0.0))
    out = rows.join(found, "row", "left").join(cover, "row", "left").withColumns({
        "length": size, "digits": count("[0-9]"), "uppers": count("[A-Z]"), "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "hexadecimal": flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")), "prefixed": flag(c.rlike(_PREFIX)),
        "changes": count("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"),
        "coverage": none(F.col("covered") / letters),
        "pathlike": flag(c.rlike(r"[a-z]/[a-z]|\.[a-z]{2,4}$") | F.col("before").rlike(r"[/\\@]$") | F.col("after").rlike(r"^[/\\@]")),
        "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"']?$") | c.rlike("^[A-Za-z_.-]{3,}=")),
    })
    return out.withColumns({k: none(F.col(k)) for k in ("pairs", "wordlike", "nearest_odds", "before_odds", "after_odds", "own_odds")}).drop("covered")


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """(candidate, before, after, label): findings made by rule, the same on every machine; about half of them are secrets."""
    return saved(spark.createDataFrame(labelled(n, SEED), "candidate string, before string, after string, label int").coalesce(1), "findings")


class Scorer:
    """Odds and forest from findings(candidate, before, after, label), with the words of the dictionary."""

    def __init__(self, findings: DataFrame, words: DataFrame):
        rows = findings.select(F.col("candidate").cast("string"), F.col("before").cast("string"), F.col("after").cast("string"), F.col("label").cast("int")).dropna().where("label in (0, 1)")
        rows = saved(rows.withColumn("half", F.pmod(F.xxhash64("candidate", "before", "after"), F.lit(2))).withColumn("row", F.monotonically_increasing_id()), "labelled")
        seen = {(r.half, r.label): r["count"] for r in rows.groupBy("half", "label").count().collect()}
        n = sum(seen.values())
        self.share = sum(k for (_, label), k in seen.items() if label) / n if n else 0.5
        self.words, self.model = words, None
        if len(seen) == 4:
            self.odds = saved(_odds(rows.where("half = 0"), words).coalesce(1), "odds")
            train = saved(self._assembled(rows.where("half = 1")).select("features", F.col("label").cast("double").alias("label")).coalesce(1), "train")
            self.model: RandomForestClassificationModel | None = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label").fit(train)

    def _assembled(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_featured(rows, self.words, self.odds))

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows(row, candidate, before, after, ...) with a score."""
        if self.model is None:
            return rows.withColumn("score", F.lit(self.share))
        return self.model.transform(self._assembled(rows)).withColumn("score", F.round(vector_to_array("probability")[1], 6))


def secret_findings(documents: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, length, score, secret) of every candidate of documents(doc_id, text, ...)."""
    spark = documents.sparkSession
    words = saved(dictionary(documents), "words")
    rows = saved(all_candidates(documents).withColumn("row", F.monotonically_increasing_id()), "candidates")
    scored = Scorer(labelled_findings(spark) if findings is None else findings, words).scored(rows)
    return scored.select("doc_id", F.col("start").cast("long").alias("start"), F.length("candidate").cast("long").alias("length"), "score", (F.col("score") >= 0.5).alias("secret"))
