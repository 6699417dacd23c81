"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of a line and the line before chooses where a chunk ends, so boundaries depend on the lines near
them and not on where in a document they stand. Chunks of two lines or more are counted over all documents; a chunk that stands at an earlier
place is an anchor. As borders depend on a line that may lie outside of what is repeated, three more kinds of range reach over them and are counted alike:

* every window of ``WINDOW`` lines, so that what is repeated is followed line by line up to its ends; a passage of so many lines or more is the union of its windows;
* from each line with words the shortest range of lines that begins there with more than ``WORDS`` words, and the shortest that ends there; a passage
  of whole lines with more than ``WORDS`` words is the union of such ranges, if it is one line.

The first copy of a range stays, which is in the document with the smallest doc_id; the lines of all others go. So a line goes only where the same line stands
at an earlier place, and the first place of each line stays.

Texts are split and hashed once; a table of ranges holds two hashes for each, of line hashes with different seeds (a partial count in each task, and hot ranges joined by broadcast, so a passage that a
third of the documents hold is no hot key). Bytes are compared line by line, in two steps, both of which tasks combine beforehand: lines of repeated hashes are grouped by hash and text, and a range with a line
whose hash stands for several texts is left alone; and the lines at each place of all copies of a range, the keeper's included, are grouped by the range's hashes and the place, and ranges with
two different lines at one place are left alone too. So hashes only propose. Bitmaps of fixed size keep documents and lines that have
no part in it out of the shuffles; the joins after them are exact.

Defined cases: null text stays null (no lines); empty text is one empty line; lines end at \\n alone; rows of one doc_id are one document,
and each keeps its first copy; a null doc_id is never the keeper unless all copies have none; ties within a document go
to the first copy; a document all of whose lines go keeps its row with empty text; an empty table gives no rows; other columns are carried through, whatever
their names. A column n_chars follows the new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.llm.common import hot_join, is_empty, saved, worked_out

#: A chunk ends after a line whose rolling hash is a multiple of this.
DIVISOR = 2
LEAST_LINES = 2
#: Repeated runs of so many lines lose their copies wherever their borders are, and so do passages of whole lines with more than WORDS words.
WINDOW = 3
WORDS = 50
BITMAP = 1 << 22  # bits
_LAST = 9223372036854775807
#: The hashes of a line, and those of the hashes of several lines, in SQL; each second one starts from another seed.
LINE_HASH, LINE_HASH_2 = "xxhash64({})", "xxhash64(1L, {})"
RANGE_HASH, RANGE_HASH_2 = "xxhash64({})", "xxhash64(2L, {})"
_PLACE = ["id", "key"]


def _placed(text: Column, doc_id: Column) -> list[Column]:
    """id: doc_id, or the largest long for null; key: hash of the document's text."""
    return [F.coalesce(doc_id.cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("key")]


def _ranges(documents: DataFrame) -> DataFrame:
    """(id, key, h1, h2, at, n, first, counted) of every line (n = 1) and every range that is counted; first: the first of its kind in the document."""
    text = F.col("text").cast("string")
    step = documents.where("text is not null").select(*_placed(text, F.col("doc_id")), F.split(text, "\n", -1).alias("ls"))
    step = worked_out(step, h="transform(ls, x -> cast(conv(substring(md5(x), 1, 7), 16, 10) as bigint))", x=f"transform(ls, x -> {LINE_HASH.format('x')})", y=f"transform(ls, x -> {LINE_HASH_2.format('x')})", w=r"transform(ls, x -> regexp_count(x, '[^\\x20\\x09-\\x0D]+'))").drop("ls")
    # lines with words only: each adds one at least, so WORDS + 1 of them are always enough, and mostly a few
    cuts = f"filter(sequence(0, size(h) - 1), i -> i = size(h) - 1 or (i > 0 and ((h[i - 1] * 31 + h[i]) % 1000003) % {DIVISOR} = 0))"
    step = worked_out(step, cuts=cuts, full="filter(transform(w, (c, i) -> struct(i as i, c as c)), f -> f.c > 0)").drop("h")
    chunks = f"filter(transform(cuts, (e, k) -> struct(if(k = 0, 0, cuts[k - 1] + 1) as at, e - if(k = 0, -1, cuts[k - 1]) as n)), c -> c.n >= {LEAST_LINES})"
    windows = f"transform(filter(sequence(0, size(x) - 1), i -> i + {WINDOW} <= size(x)), i -> struct(i as at, {WINDOW} as n))"
    sums = lambda part: f"aggregate({part}, struct(0 as s, 0 as n), (a, f) -> if(a.s > {WORDS}, a, struct(a.s + f.c as s, a.n + 1 as n)))"
    ahead = lambda m: sums(f"slice(full, k + 1, {m})")
    back = lambda m: sums(f"reverse(slice(full, greatest(k - {m - 1}, 0) + 1, least(k, {m - 1}) + 1))")
    step = worked_out(step, ahead=f"transform(full, (f, k) -> {ahead(4)})", back=f"transform(full, (f, k) -> {back(4)})")
    more = lambda name, part: f"transform({name}, (a, k) -> if(a.s > {WORDS}, a, {part(WORDS + 1)}))"
    step = worked_out(step.withColumnsRenamed({"ahead": "ahead4", "back": "back4"}), ahead=more("ahead4", ahead), back=more("back4", back)).drop("ahead4", "back4")
    long = [
        f"filter(transform(ahead, (a, k) -> if(a.s > {WORDS}, struct(full[k].i as at, full[k + a.n - 1].i - full[k].i + 1 as n), null)), r -> r.n > 1)",
        f"filter(transform(back, (a, k) -> if(a.s > {WORDS}, struct(full[k - a.n + 1].i as at, full[k].i - full[k - a.n + 1].i + 1 as n), null)), r -> r.n > 1)",
    ]
    single = f"transform(x, (v, i) -> struct(v as h1, y[i] as h2, i as at, 1 as n, w[i] > {WORDS} as counted))"
    many = f"transform(concat({chunks}, {windows}, {', '.join(long)}), r -> struct({RANGE_HASH.format('slice(x, r.at + 1, r.n)')} as h1, {RANGE_HASH_2.format('slice(y, r.at + 1, r.n)')} as h2, r.at as at, r.n as n, true as counted))"
    # equal ranges stand side by side once sorted
    step = worked_out(step, all=f"array_sort(concat({single}, {many}))")
    marked = "transform(all, (r, i) -> struct(r.h1 as h1, r.h2 as h2, r.at as at, r.n as n, i = 0 or all[i - 1].h1 <> r.h1 or all[i - 1].h2 <> r.h2 as first, r.counted as counted, i = 0 or all[i - 1] <> r as new))"
    return step.select("id", "key", F.expr(f"inline({marked})")).where("new").drop("new")


def _bits(of: Column, rows: DataFrame) -> DataFrame:
    """A bitmap of a long column's hashes as rows (w, bits), of which there are at most BITMAP / 64, to be broadcast."""
    bit = F.pmod(of, F.lit(BITMAP))
    return rows.select((bit / 64).cast("int").alias("w"), bit.alias("bit")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))


def _marked(rows: DataFrame, of: Column, bits: DataFrame, how: str) -> DataFrame:
    """rows whose long ``of`` may be (``left_semi``) or surely isn't (``left_anti``) in the bitmap."""
    bit = F.pmod(of, F.lit(BITMAP))
    return rows.join(F.broadcast(bits), ((bit / 64).cast("int") == F.col("w")) & (F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))) != 0), how)


def _differing(documents: DataFrame, copies: DataFrame) -> DataFrame:
    """(h1, h2) of ranges of several lines, of copies(id, key, at, n, h1, h2), whose lines differ by one of their hashes at some place."""
    # the ranges of one document, whose size bounds them
    of = saved(copies.where("n > 1").groupBy(*_PLACE).agg(F.collect_list(F.struct("h1", "h2", "at", "n")).alias("rs")), "copies")
    text = F.col("text").cast("string")
    rows = documents.where("text is not null").select(*_placed(text, F.col("doc_id")), text.alias("text"))
    rows = _marked(rows, F.xxhash64(*_PLACE), saved(_bits(F.xxhash64(*_PLACE), of), "bits"), "left_semi")
    lines = worked_out(rows.select(*_PLACE, F.split("text", "\n", -1).alias("ls")), x=f"transform(ls, x -> struct({LINE_HASH.format('x')} as a, {LINE_HASH_2.format('x')} as b))").select(*_PLACE, "x")
    each = lines.join(of, _PLACE).select("x", F.explode("rs").alias("r")).select("r.h1", "r.h2", F.expr("posexplode(slice(x, r.at + 1, r.n))").alias("place", "line"))
    each = each.groupBy("h1", "h2", "place").agg(*(f(f"line.{c}").alias(f"{name}_{c}") for c in "ab" for name, f in (("least", F.min), ("most", F.max))))
    return each.where("least_a <> most_a or least_b <> most_b").select("h1", "h2").distinct()


def repeated_ranges(documents: DataFrame) -> DataFrame:
    """(id, key, at, n) of the ranges to remove: the first line and the number of lines."""
    ranges = saved(_ranges(documents), "ranges")
    many = saved(ranges.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.count("*").alias("copies"), F.max("n").alias("lines"), F.bool_or("counted").alias("counted")).where("copies > 1"), "repeated")
    wanted = many.where("counted").select("h1", "h2", "keeper", "copies")
    found = hot_join(_marked(ranges.where("counted"), F.xxhash64("h1"), saved(_bits(F.xxhash64("h1"), wanted), "bits"), "left_semi"), wanted, ["h1", "h2"], "copies")
    found = saved(found.select("id", "key", "at", "n", "h1", "h2", (F.col("id") != F.col("keeper")).alias("later"), "first", "copies"), "found")
    gone = found.where("later or not first")

    # bytes: all texts of the lines that are repeated, and the lines of all copies of a range
    line = F.explode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line")
    texts = documents.where("text is not null").select(line).withColumn("h1", F.expr(LINE_HASH.format("line")))
    texts = _marked(texts, F.xxhash64("h1"), saved(_bits(F.xxhash64("h1"), many.where("lines = 1")), "bits"), "left_semi").groupBy("h1", "line").agg(F.count("*").alias("n"))
    mixed = saved(texts.groupBy("h1").agg(F.count("*").alias("texts")).where("texts > 1").select("h1"), "mixed")
    differing = saved(_differing(documents, found), "differing")
    if not is_empty(differing):
        gone = gone.join(differing, ["h1", "h2"], "left_anti")
    gone = gone.select("id", "key", "at", "n")
    if not is_empty(mixed):
        at = ranges.where("n = 1").join(mixed, "h1").select("id", "key", F.col("at").alias("line"))
        gone = gone.join(at.withColumnsRenamed({"id": "i", "key": "k"}), (F.col("id") == F.col("i")) & (F.col("key") == F.col("k")) & F.col("line").between(F.col("at"), F.col("at") + F.col("n") - 1), "left_anti")
    return gone


def without_repeated_passages(documents: DataFrame, counts: bool = False) -> DataFrame:
    """documents with the copies of repeated ranges of lines removed from text; with ``counts``, n_lines and n_removed (lines) are added."""
    # the ranges of one document, whose size bounds them
    gone = repeated_ranges(documents).groupBy(*_PLACE).agg(F.expr("array_distinct(flatten(transform(collect_list(struct(at, n)), r -> sequence(r.at, r.at + r.n - 1))))").alias("gone"))
    gone = saved(gone, "gone")
    text = F.col("row.text").cast("string")
    rows = documents.select(F.struct("*").alias("row"))
    rows = rows.select("row", *_placed(text, F.col("row.doc_id")))
    bits = saved(_bits(F.xxhash64(*_PLACE), gone), "bits")
    of = F.xxhash64(*_PLACE)
    # documents that lose nothing aren't shuffled
    whole = _marked(rows, of, bits, "left_anti").withColumn("gone", F.lit(None).cast("array<int>"))
    rows = whole.unionByName(_marked(rows, of, bits, "left_semi").join(gone, _PLACE, "left"))
    lines = F.split(text, "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "gone"), lambda i: F.get("ls", i))
    rows = rows.withColumn("ls", lines).withColumn("text", F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n")))
    columns = []
    for f in documents.schema.fields:
        mine = F.col("row").getField(f.name)
        if f.name == "text":
            mine = F.col("text").cast(f.dataType)
        elif f.name == "n_chars":
            mine = F.when(F.col("gone").isNull(), mine).otherwise(F.length("text").cast(f.dataType))
        columns.append(mine.alias(f.name))
    if counts:
        columns += [F.when(text.isNull(), 0).otherwise(F.size("ls")).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed")]
    return rows.select(*columns)
