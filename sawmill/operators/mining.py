"""Template mining over distinct samples, as joins and grouped aggregates.

A log that is parsed line by line gives templates that depend on the lines before. Here the same steps run over sets: samples are
counted, near ones linked, components merged to templates by their common runs, and templates split where one gap
has few values. No dataset is gathered in one task: links come from an equi-join on rare words, merging folds partial results of
tasks, gap values are counted by groups.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from sawmill.functions import text as T
from sawmill.functions.regexes import java, template_pattern_column
from sawmill.operators import lcs
from sawmill.operators.match import containment
from sawmill.plans.tables import components, hot_join, saved

#: Samples at a distance of at most this are near.
NEAR = 0.3
#: Two near templates are one where the rows of their distance matrix are within NEAR: for a pair, at a distance of NEAR / sqrt(2).
JOINED = NEAR / math.sqrt(2)
#: A template of n lines is split by a gap of at most round(log(n, SPLIT_BASE)) values.
SPLIT_BASE = 2


def samples(lines: DataFrame) -> DataFrame:
    """(dataset, sample_text, log_num, first_line, sample_id) of lines(dataset, line_no, content), content being masked."""
    rows = lines.where("content is not null").groupBy("dataset", F.col("content").alias("sample_text")).agg(F.count("*").alias("log_num"), F.min("line_no").alias("first_line"))
    return rows.withColumn("sample_id", F.xxhash64("dataset", "sample_text"))


@F.pandas_udf(DoubleType())
def _distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict[tuple, float] = {}  # of pairs that are alike, over the batches of a task
    for a, b in batches:
        if len(known) > KNOWN:
            known.clear()
        yield pd.Series(lcs.distances(a.tolist(), b.tolist(), known))


#: Distances that a task keeps before it starts anew.
KNOWN = 50_000


def distance_pairs(found: DataFrame, limit: float = NEAR) -> DataFrame:
    """(dataset, a, b, distance) of samples of a dataset whose distance is at most ``limit``; a and b are sample_ids."""
    return _tried(found, limit).withColumn("distance", _distance("ta", "tb")).where(F.col("distance") <= limit).select("dataset", "a", "b", "distance")


def _tried(found: DataFrame, limit: float) -> DataFrame:
    """(dataset, a, b, ta, tb): pairs of samples that have enough words in common, with their texts; numbers don't matter.

    Common words are at least (1 - limit) of the longer text's words. So of the rarest words of both, taken as far as that leaves
    open, one is shared: the join is on those words, and the measure runs on what it brings together.
    """
    words = F.filter(T.tokens(F.col("sample_text")), T.is_word_token)
    rows = found.select("dataset", "sample_id", "sample_text", words.alias("w")).withColumn("n", F.size("w")).where("n > 0")
    each = rows.select("dataset", "sample_id", "n", F.explode("w").alias("word")).groupBy("dataset", "sample_id", "n", "word").agg(F.count("*").alias("k"))
    common = each.groupBy("dataset", "word").agg(F.count("*").alias("df"))
    order = Window.partitionBy("sample_id").orderBy("df", "word").rowsBetween(Window.unboundedPreceding, -1)
    rare = each.join(common, ["dataset", "word"]).withColumn("before", F.coalesce(F.sum("k").over(order), F.lit(0)))
    rare = rare.where(F.col("before") <= F.col("n") - F.ceil(F.col("n") * (1 - limit) - 1e-9)).select("dataset", "word", "sample_id", "n")
    other = rare.select("dataset", "word", F.col("sample_id").alias("b"), F.col("n").alias("m"))
    near = rare.withColumnRenamed("sample_id", "a").join(other, ["dataset", "word"]).where(F.col("a") < F.col("b")).where(F.least("n", "m") >= F.greatest("n", "m") * (1 - limit) - 1e-9)
    texts = rows.select("sample_id", "sample_text")
    return near.select("dataset", "a", "b").distinct().join(texts.withColumnsRenamed({"sample_id": "a", "sample_text": "ta"}), "a").join(texts.withColumnsRenamed({"sample_id": "b", "sample_text": "tb"}), "b")


#: A pair that shares no word is at distance 1; all others are nearer than this.
APART = 1 - 1e-6


def distance_matrix(found: DataFrame) -> DataFrame:
    """(dataset, a, b, distance) for every pair of samples of a dataset that are nearer than 1, both ways; all others are at 1, and a sample is at 0 from itself.

    Distances are narrowed to 32 bits, as the rows are compared in them. The join is on all words, so it is meant for tables of templates, not for all samples of a log.
    """
    half = saved(distance_pairs(found, APART), "matrix").withColumn("distance", F.col("distance").cast("float").cast("double"))
    return half.unionByName(half.select("dataset", F.col("b").alias("a"), F.col("a").alias("b"), "distance"))


def row_pairs(found: DataFrame, limit: float = NEAR) -> DataFrame:
    """(dataset, a, b, row_distance) of samples whose rows of the distance matrix are within ``limit`` of each other, a < b.

    The row distance is the root of the sum, over all samples k, of the squared difference of the distances to k. The two places k = a and k = b alone give
    twice the square of the pair's own distance, so only pairs within limit / sqrt(2) are tried; and as all entries but those of ``distance_matrix`` are 1 in both rows, the sum
    runs over the neighbours of a and b: an equi-join on the pair's side and a grouped sum by k.
    """
    matrix = saved(distance_matrix(found), "matrix")
    tried = saved(matrix.where(F.col("a") < F.col("b")).where(F.col("distance") <= limit / math.sqrt(2) + 1e-6).select("dataset", "a", "b"), "tried")
    own = tried.select(F.col("a").alias("k")).union(tried.select("b")).distinct()
    rows = matrix.select("a", F.col("b").alias("k"), (1 - F.col("distance")).alias("near")).unionByName(own.select(F.col("k").alias("a"), "k", F.lit(1.0).alias("near")))
    side = lambda c, sign: tried.join(rows.withColumnRenamed("a", c), c).select("dataset", "a", "b", "k", (sign * F.col("near")).alias("near"))
    each = side("a", 1).unionByName(side("b", -1)).groupBy("dataset", "a", "b", "k").agg(F.sum("near").alias("d"))
    return each.groupBy("dataset", "a", "b").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("row_distance")).where(F.col("row_distance") <= limit)


def row_clusters(found: DataFrame, limit: float = NEAR) -> DataFrame:
    """found with a cluster: the smallest sample_id reachable by steps between rows of the distance matrix that are within ``limit``.

    That is density clustering with one point as the least size, on the rows of the matrix of all samples of a dataset. Texts without word tokens are alone.
    """
    roots = components(saved(row_pairs(found, limit).select("a", "b"), "row-pairs"))
    return found.join(roots.withColumnsRenamed({"node": "sample_id", "root": "cluster"}), "sample_id", "left").select(*found.columns, F.coalesce("cluster", "sample_id").alias("cluster"))


#: A token that is a number: a whole run of the signs of words, with one of \\w in it, without a letter.
_NUMBER = java(r"(?<![\w\-\\/.])[\-\\/.]*+(?=\w)(?:(?![a-zA-Z])[\w\-\\/.])++(?![\w\-\\/.])")


def _shapes(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """found with its shape (the tokens, numbers being all alike), (shape, a, n): the first sample of each and their number, and these first samples.

    Signs belong to the shape, as common signs decide which words a common subsequence takes.
    """
    # numbers are whole tokens, and so is what stands for them: the text tells the tokens
    shaped = saved(found.withColumn("shape", F.xxhash64("dataset", F.regexp_replace("sample_text", _NUMBER, "0"))), "shapes")
    firsts = saved(shaped.groupBy("shape").agg(F.min("sample_id").alias("a"), F.count("*").alias("n")), "firsts")
    return shaped, firsts, saved(found.join(firsts.select(F.col("a").alias("sample_id")), "sample_id", "left_semi"), "shape-heads")


def _kind(limit: float):
    @F.pandas_udf(StringType())
    def kind(a: pd.Series, b: pd.Series, alone: pd.Series) -> pd.Series:
        out = pd.Series("", index=a.index, dtype=object)
        out[alone] = ["all" if d <= limit else "none" for d in lcs.distances(a[alone].tolist(), b[alone].tolist())]
        out[~alone] = lcs.kinds(a[~alone].tolist(), b[~alone].tolist(), limit)
        return out

    return kind


#: Samples of a shape that meet those of another one in one go, where they are measured one by one.
PAIRED = 1024


def _one_by_one(shaped: DataFrame, firsts: DataFrame, kinds: DataFrame, limit: float) -> DataFrame:
    """(dataset, a, b, distance) of samples within ``limit``, of the shapes whose heads are the a and b of kinds(a, b, na, nb, kind): all their pairs, or for the kind share those with a number in common.

    Shapes are dealt in pairs of bounded blocks, so no task takes a whole one.
    """
    # a head for each of these shapes, with the number of its samples
    heads = kinds.select("a").union(kinds.select("b")).distinct()
    few = saved(hot_join(shaped, saved(firsts.join(heads, "a"), "open"), "shape"), "opened")
    numbers = F.filter(T.tokens(F.col("sample_text")), lambda t: ~T.is_word_token(t) & t.rlike(java(r"\w")))
    dealt = few.select(F.col("a").alias("head"), F.expr(f"pmod(xxhash64(sample_id, 3), cast(ceil(n / {PAIRED}) as bigint))").alias("block"), "dataset", "sample_id", F.explode(F.array_union(F.array(F.lit("")), numbers)).alias("number"))
    blocks = lambda n: F.explode(F.expr(f"sequence(0L, cast(ceil({n} / {PAIRED}) as bigint) - 1)"))
    meet = kinds.select("a", "b", "nb", "kind", blocks("na").alias("i")).select("a", "b", "kind", "i", blocks("nb").alias("j"))
    left = dealt.withColumnsRenamed({"head": "a", "block": "i", "sample_id": "x"})
    right = dealt.drop("dataset").withColumnsRenamed({"head": "b", "block": "j", "sample_id": "y"})
    met = meet.join(left, ["a", "i"]).where((F.col("kind") == "some") == (F.col("number") == "")).join(right, ["b", "j", "number"])
    met = met.where("a <> b or x < y").select("dataset", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    texts = few.select("sample_id", "sample_text")
    pairs = met.join(texts.withColumnsRenamed({"sample_id": "a", "sample_text": "ta"}), "a").join(texts.withColumnsRenamed({"sample_id": "b", "sample_text": "tb"}), "b")
    return pairs.withColumn("distance", _distance("ta", "tb")).where(F.col("distance") <= limit).select("dataset", "a", "b", "distance")


def distance_links(found: DataFrame, limit: float = NEAR) -> DataFrame:
    """(dataset, a, b, distance, member, whole): all pairs of samples within ``limit``, those of like shapes in one row; distance is that of a and b.

    * member: b is a sample of the shape whose first sample (head) is a. All of a shape have such a row, but its head. whole: every two samples of the shape are within ``limit``.
    * not member, whole: a and b are heads, and every sample of the one shape is within ``limit`` of every sample of the other.
    * not member, not whole: the samples a and b are within ``limit``.

    A pair within ``limit`` is in one of these, and no other pair is. Texts of one shape differ in numbers, and the measure depends on the numbers that two texts share: a row is whole where no
    such numbers take a pair over the limit (``lcs.kinds``); else the pairs are measured one by one.
    """
    shaped, firsts, heads = _shapes(found)
    of = saved(firsts.join(heads.select("dataset", F.col("sample_id").alias("a"), F.col("sample_text").alias("ta")), "a"), "heads")
    size = of.select("a", F.col("n").alias("na"))
    pairs = _tried(heads, limit).join(size, "a").join(size.withColumnsRenamed({"a": "b", "na": "nb"}), "b")
    own = of.where("n > 1").select("dataset", "a", F.col("a").alias("b"), "ta", F.col("ta").alias("tb"), F.col("n").alias("na"), F.col("n").alias("nb"))
    pairs = pairs.unionByName(own).withColumn("kind", _kind(limit)("ta", "tb", F.expr("na = 1 and nb = 1")))
    kinds = saved(pairs.where("kind <> 'none'"), "kinds")
    of = saved(of.drop("dataset").join(kinds.where("a = b").select("a", F.col("kind") == "all"), "a", "left").toDF("a", "shape", "n", "ta", "whole"), "wholes")
    members = hot_join(shaped.select("dataset", "shape", F.col("sample_id").alias("b"), F.col("sample_text").alias("tb")), of, "shape").where("a <> b")
    links = members.select("dataset", "a", "b", _distance("ta", "tb").alias("distance"), F.lit(True).alias("member"), F.coalesce("whole", F.lit(False)).alias("whole"))
    whole = kinds.where("kind = 'all' and a <> b").select("dataset", "a", "b", _distance("ta", "tb").alias("distance"), F.lit(False).alias("member"), F.lit(True).alias("whole"))
    links = links.unionByName(whole)
    some = kinds.where("kind <> 'all'").select("a", "b", "na", "nb", "kind")
    if not some.take(1):
        return links
    return links.unionByName(_one_by_one(shaped, firsts, some, limit).select("*", F.lit(False).alias("member"), F.lit(False).alias("whole")))


def clusters(found: DataFrame, limit: float = JOINED) -> DataFrame:
    """samples with a cluster: the smallest sample_id reachable by distances of at most ``limit``.

    Samples that differ in numbers only are one from the start; only the first of each such shape meets others in pairs, and the
    rest follow it.
    """
    shaped, firsts, heads = _shapes(found)
    roots = components(saved(distance_pairs(heads, limit).select("a", "b"), "pairs"))
    of = firsts.join(roots.withColumnsRenamed({"node": "a", "root": "cluster"}), "a", "left").select("shape", "n", F.coalesce("cluster", "a").alias("cluster"))
    return hot_join(shaped, saved(of, "clusters"), "shape").select(*found.columns, "cluster")


def _joined_tokens(text: Column) -> Column:
    """The tokens of a text as ``lcs.joined`` has them, for one split in a worker; a text that holds the bar itself comes as it is, behind another sign."""
    bars = F.concat(F.lit(lcs.BAR), F.regexp_replace(text, "(?s)" + java(T.TOKEN), "$0" + lcs.BAR))
    return F.when(F.contains(text, F.lit(lcs.BAR)), F.concat(F.lit("="), text)).otherwise(bars)


#: Results of foldings that a task keeps before it starts anew.
STEPS = 50_000


class _Folded:
    """Common runs, their tokens, and what they become with a text, by as much of it as such tokens make up; the texts of one log are few in that."""

    def __init__(self, runs: lcs.Runs):
        self.runs, self.known, self.steps = runs, {t for r in runs for t in r}, {}


def _folding(weighted: bool, texts: bool):
    """Folds the rows sorted by (cluster, part), texts or runs: the common runs of each, with its first line; one part is held at a time."""
    kind = pa.list_(pa.list_(pa.string()))

    def folded(done: list[tuple]) -> pa.RecordBatch:
        cluster, part, line, held = zip(*done) if done else ((), (), (), ())
        columns = [pa.array(cluster, pa.int64()), pa.array(part, pa.int64()), pa.array(line, pa.int64()), pa.array([h.runs for h in held], kind)]
        return pa.RecordBatch.from_arrays(columns, names=["cluster", "part", "first_line", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, line = None, None, None
        every: dict[tuple, _Folded] = {}  # by their runs, over the parts of a task
        steps = 0
        for batch in batches:
            done: list[tuple] = []
            for cluster, part, first, runs in zip(*(c.to_pylist() for c in batch.columns)):
                runs = [lcs.parted(runs)] if texts else runs
                if (cluster, part) != last:
                    if held is not None:
                        done.append((*last, line, held))
                    last, held, line = (cluster, part), _Folded(runs), first
                    continue
                shape = lcs.shape(runs[0], held.known) if texts else tuple([lcs.shape(r, held.known) for r in runs])
                if (now := held.steps.get(shape)) is None:
                    if (steps := steps + 1) > STEPS:
                        every, steps = {}, 1
                        held = _Folded(held.runs)
                    folds = lcs.fold(held.runs, runs, weighted)
                    now = held if folds == held.runs else every.setdefault(tuple(map(tuple, folds)), _Folded(folds))
                    held.steps[shape] = now
                held = now
            yield folded(done)
        if held is not None:
            yield folded([(*last, line, held)])

    return run


#: Texts or results that are folded in one go.
FAN = 512


def merged(clustered: DataFrame, weighted: bool = False) -> DataFrame:
    """(cluster, runs): the common runs of each cluster, of tokens that weigh alike or by their words and signs.

    A cluster's samples are dealt by a hash to parts of about FAN, each folded in the order of first lines; then FAN results of parts are folded at a time until
    one is left. Another order may find other runs, all of them common; this one depends on the samples alone.
    """
    schema = "cluster long, part long, first_line long, runs array<array<string>>"
    sizes = saved(clustered.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    parts = sizes.agg(F.max(F.ceil(F.col("n") / FAN))).first()[0] or 0
    # hot_join reads its rows twice, so they get their tokens after it
    rows = hot_join(clustered.select("cluster", "sample_id", "first_line", "sample_text"), sizes, "cluster").withColumn("tokens", _joined_tokens(F.col("sample_text"))).drop("sample_text")
    rows = rows.withColumn("part", F.expr(f"pmod(xxhash64(sample_id, 5), cast(ceil(n / {FAN}) as bigint))")).withColumn("at", F.col("sample_id"))
    text, order = "tokens", ["cluster", "part"]
    while True:
        rows = rows.repartition(*order).sortWithinPartitions(*order, "first_line", "at").select("cluster", "part", "first_line", text).mapInArrow(_folding(weighted, text != "runs"), schema)
        text = "runs"
        if parts <= 1:
            return rows.select("cluster", "runs")
        parts = -(-parts // FAN)
        rows = rows.withColumn("at", F.col("part")).withColumn("part", F.expr(f"part div {FAN}"))


def _joined(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.array_join(r, "")), T.WILDCARD)


def templates(clustered: DataFrame) -> DataFrame:
    """(cluster, template_text): runs joined by wildcards, with one before or after them where that is needed to match all samples."""
    base = merged(clustered).select("cluster", _joined(F.col("runs")).alias("t"))
    forms = [F.col("t"), F.concat(F.lit(T.WILDCARD), "t"), F.concat("t", F.lit(T.WILDCARD)), F.concat(F.lit(T.WILDCARD), "t", F.lit(T.WILDCARD))]
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n")).join(base, "cluster").select("cluster", "n", *(f.alias(f"form{k}") for k, f in enumerate(forms)))
    sizes = saved(sizes.withColumns({f"pattern{k}": template_pattern_column(F.col(f"form{k}")) for k in range(4)}), "forms")
    # a cluster's rows stand together, so each of the four patterns is compiled once for a cluster in a task
    rows = hot_join(clustered.select("cluster", "sample_text"), sizes, "cluster").sortWithinPartitions("cluster")
    fits = rows.groupBy("cluster").agg(*(F.bool_and(F.expr(f"sample_text rlike pattern{k}")).alias(f"fits{k}") for k in range(3)))
    best = fits.join(sizes.select("cluster", *(f"form{k}" for k in range(4))), "cluster")
    best = best.select("cluster", F.when(F.col("fits0"), F.col("form0")).when(F.col("fits1"), F.col("form1")).when(F.col("fits2"), F.col("form2")).otherwise(F.col("form3")).alias("template_text"))
    best = T.collapse_wildcards(best, "template_text")
    # a merge that leaves no letter is none: each sample stays its own template
    return best.where(T.has_word(F.col("template_text")))


@F.pandas_udf(ArrayType(StringType()))
def _gaps(text: pd.Series, runs: pd.Series) -> pd.Series:
    known = {r: [lcs.joined(run) for run in json.loads(r)] for r in runs.unique()}
    return pd.Series([lcs.gaps_in(t if t[0] == lcs.BAR else lcs.joined(lcs.parted(t)), known[r]) for t, r in zip(text, runs)])


def _tops(names: DataFrame) -> DataFrame:
    """(covered_id, to) of names(template_id, template_text, ord, dataset) that another one of the dataset covers: the last coverer that none covers itself.

    Of names that cover each other the one seen first stays.
    """
    order = names.select("template_id", "ord")
    covers = containment(names).join(order.withColumnsRenamed({"template_id": "coverer_id", "ord": "by"}), "coverer_id").join(order.withColumnsRenamed({"template_id": "covered_id", "ord": "at"}), "covered_id")
    back = covers.select(F.col("coverer_id").alias("covered_id"), F.col("covered_id").alias("coverer_id"), F.lit(True).alias("mutual"))
    covers = saved(covers.join(back, ["covered_id", "coverer_id"], "left").where("mutual is null or by < at").select("covered_id", "coverer_id", "by"), "covers")
    return covers.join(covers.select(F.col("covered_id").alias("coverer_id")).distinct(), "coverer_id", "left_anti").groupBy("covered_id").agg(F.max_by("coverer_id", F.struct("by", "coverer_id")).alias("to"))


def _merged_values(gaps: DataFrame) -> DataFrame:
    """(cluster, gap, value, merged): the value of a gap that takes this one in, as its pattern matches it, with placeholders and wildcards made one."""
    values = gaps.groupBy("cluster", "gap", "value").agg(F.min("first_line").alias("ord"))
    values = saved(values.withColumn("template_id", F.xxhash64("cluster", "gap", "value")).withColumn("dataset", F.concat_ws(" ", "cluster", "gap")), "values")
    wild = values.where(F.col("value").contains(T.WILDCARD)).select("dataset").distinct()  # elsewhere no value covers another
    if not wild.take(1):
        return T.collapse_wildcards(values.withColumn("merged", T.normalize_placeholders(F.col("value"))), "merged").select("cluster", "gap", "value", "merged")
    top = _tops(values.join(wild, "dataset", "left_semi").withColumnRenamed("value", "template_text").select("dataset", "template_id", "template_text", "ord"))
    by = values.select(F.col("template_id").alias("to"), F.col("value").alias("by"))
    joined = values.join(top.withColumnRenamed("covered_id", "template_id").join(by, "to"), "template_id", "left")
    return T.collapse_wildcards(joined.withColumn("merged", T.normalize_placeholders(F.coalesce("by", "value"))), "merged").select("cluster", "gap", "value", "merged")


def split_clusters(clustered: DataFrame, base: int = SPLIT_BASE) -> DataFrame:
    """(cluster, sample_id, branch, template_text) of the samples of clusters that are split, by the value of one gap between common runs (weighted ones).

    The gap with the fewest values is taken, the first of several; a gap needs two values or more, one of them with a letter outside
    wildcards, and no more of them than round(log(lines of the cluster, base)). A branch's template has the value in that gap ({V} for none, but
    before the first run), and elsewhere the gap's one value or a wildcard. A branch without a letter is none and has a null: its samples are their own templates.
    """
    runs = saved(merged(clustered, weighted=True), "runs")
    sizes = saved(clustered.groupBy("cluster").agg(F.sum("log_num").alias("lines"), F.count("*").alias("n")).join(runs, "cluster"), "sizes")
    gaps = hot_join(clustered.select("cluster", "sample_id", "sample_text", "first_line"), sizes.where("n > 1").select("cluster", "n", F.to_json("runs").alias("runs")), "cluster")
    gaps = saved(gaps.select("cluster", "sample_id", "first_line", F.posexplode(_gaps(_joined_tokens(F.col("sample_text")), "runs")).alias("gap", "value")), "gaps")
    become = saved(_merged_values(gaps), "become")
    values = become.groupBy("cluster", "gap").agg(F.count_distinct("merged").alias("values"), F.bool_or(T.has_word(F.col("merged"))).alias("worded"), F.min("merged").alias("one"))
    values = saved(values.join(sizes.select("cluster", "lines"), "cluster"), "gap-values")
    most = F.rint(F.log(float(base), F.greatest(F.col("lines"), F.lit(1))))
    chosen = saved(values.where("values > 1 and worded").where(F.col("values") <= most).groupBy("cluster").agg(F.min_by("gap", F.struct("values", "gap")).alias("gap")), "chosen")
    # the gaps of one cluster: as many as its runs, and one more
    pieces = values.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("gap", F.when(F.col("values") == 1, F.col("one")).otherwise(T.WILDCARD).alias("piece")))).alias("pieces"))
    named = become.join(chosen, ["cluster", "gap"]).select("cluster", "gap", "merged").distinct().join(pieces, "cluster").join(runs, "cluster")
    named = named.withColumn("own", F.when((F.col("merged") == "") & (F.col("gap") != 0), "{V}").otherwise(F.col("merged")))
    named = named.withColumn("template_text", F.expr("array_join(transform(pieces, (p, i) -> concat(if(i = gap, own, p.piece), coalesce(array_join(get(runs, i), ''), ''))), '')"))
    named = T.collapse_wildcards(named, "template_text").select("cluster", "merged", F.when(T.has_word(F.col("template_text")), F.col("template_text")).alias("template_text"))
    named = saved(named, "branches")
    # few branches for each cluster, as their number is at most the logarithm of its lines
    of = become.join(chosen, ["cluster", "gap"]).join(named, ["cluster", "merged"])
    of = saved(gaps.groupBy("cluster", "gap", "value").agg(F.count("*").alias("n")).join(of, ["cluster", "gap", "value"]), "values")
    small = hot_join(gaps.select("cluster", "gap", "value", "sample_id"), of, ["cluster", "gap", "value"])
    return small.select("cluster", "sample_id", F.col("merged").alias("branch"), "template_text")


def absorbed(found: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples and templates without the templates that another one of the dataset covers; their samples go to the last coverer.

    Of templates that cover each other the one seen first stays.
    """
    top = saved(_tops(names), "tops")
    sizes = found.groupBy("template_id").agg(F.count("*").alias("n"))
    to = saved(top.join(sizes.withColumnRenamed("template_id", "covered_id"), "covered_id").withColumnRenamed("covered_id", "template_id"), "moves")
    moved = hot_join(found, to, "template_id", how="left").withColumn("template_id", F.coalesce("to", "template_id"))
    return moved.select(*found.columns), names.join(top.select(F.col("covered_id").alias("template_id")), "template_id", "left_anti").select(*names.columns)


def mine(lines: DataFrame, merge: bool = True, split: bool = True, contained: bool = False) -> tuple[DataFrame, DataFrame]:
    """(samples(dataset, sample_id, sample_text, log_num, first_line, template_id), templates(template_id, template_text, ord)) of lines.

    lines(dataset, line_no, content): content is preprocessed. Texts of fewer than two words are their own templates.
    With ``contained``, templates that others cover stay.
    """
    found = saved(samples(lines), "samples")
    many = found.where(~T.one_word(F.col("sample_text")))
    grouped = saved(clusters(many) if merge else many.withColumn("cluster", F.col("sample_id")), "clusters")
    columns = ["dataset", "sample_id", "sample_text", "log_num", "first_line", "template_text"]
    parts = [found.where(T.one_word(F.col("sample_text"))).withColumn("template_text", F.col("sample_text")).select(*columns)]
    if split and merge:
        branches = saved(split_clusters(grouped), "splits")
        both = saved(grouped.join(branches.select("sample_id", "template_text", F.lit(True).alias("split")), "sample_id", "left"), "clusters")
        parts.append(both.where("split").withColumn("template_text", F.coalesce("template_text", "sample_text")).select(*columns))
        grouped = both.where("split is null").drop("template_text", "split")
    if merge:
        texts = templates(grouped)
        sizes = grouped.groupBy("cluster").agg(F.count("*").alias("n")).join(texts, "cluster")
        grouped = hot_join(grouped, saved(sizes, "texts"), "cluster", how="left")
    else:
        grouped = grouped.withColumn("template_text", F.lit(None).cast("string"))
    parts.append(grouped.withColumn("template_text", F.coalesce("template_text", "sample_text")).select(*columns))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = saved(every.withColumn("template_id", F.xxhash64("dataset", "template_text")), "mined")
    names = every.groupBy("dataset", "template_id", "template_text").agg(F.min("first_line").alias("ord"))
    every = every.drop("template_text")
    return (every, names) if contained or not merge else absorbed(every, saved(names, "names"))
