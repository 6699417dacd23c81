"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

1. Every document becomes its set of 5-word shingles (64-bit hashes); documents with equal sets (by size and a 128-bit digest) form a class, which
   is named after its smallest doc_id.
2. A class has a signature of ``CHUNKS * CHUNK`` b-bit minima, cut into ``CHUNKS`` chunks. Within a chunk one error is
   allowed; it is enumerated by leaving out each of the ``CHUNK`` places in turn. By the pigeonhole principle two
   signatures with at most ``2 * CHUNKS - 1`` differing places share a key; at similarity 0.75 a chunk has at most one
   error with probability 0.63, so a pair is missed with probability below 0.00005.
3. In each bucket the members are confirmed against its smallest member on full sets; confirmed links are joined to
   components. So a large group of near copies costs a number of checks in proportion to its size; the members of a leader of many are dealt to
   blocks, each of which gets the leader's set once.
4. Members of a bucket that are still in different components meet in blocks of at most ``2 * BLOCK`` rows: those outside the bucket's largest component meet each other and
   that component, whose own members need not meet. So a group of n copies with m strays makes m * n pairs, not n * n. An odd
   sketch bounds the symmetric difference, which drops most pairs.
5. The rest is confirmed on full sets in ROUNDS: of each component's pairs some 2 * TRIES at first, whose links join components, then again of what is still apart, the last round
   all that are left (or at once, where they are few); pairs whose components
   have become one meanwhile are done. What is asked for are components, so no further pair of the same two changes the result. So m near-equal strays cost pairs in proportion to m.

Defined cases: null or wordless text has n_shingles 0 and is linked with nothing; a null doc_id is linked with nothing
(component_id null, kept true); rows with one doc_id are one document, whose texts are all linked with each other;
fewer than five words make one shingle; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.llm import textbytes as tb
from sawmill.llm.common import HOT, bits_of, components, fewer, hot_join, is_empty, lean, saved, small_batches

SHINGLE = 5
CHUNKS, CHUNK, BITS = 10, 5, 16
PLACES = CHUNKS * CHUNK
ODD_BITS = 1024
BLOCK = 512
#: Rounds of confirming pairs of components, and pairs of each component in a round, on either side.
ROUNDS, TRIES = 3, 4
#: 100 * intersection >= PERCENT * union
PERCENT = 75

_U = np.uint64
_MUL = tb._splitmix(PLACES, 5) | _U(1)
_XOR = tb._splitmix(PLACES, 9)
_SALT = tb._splitmix(PLACES + 1, 31)


def _sets(batch: pa.RecordBatch):
    """(rows i..j, distinct shingle hashes of these rows joined, where each row's begin)."""
    raw, offsets = tb.text_buffer(batch.column(batch.schema.get_field_index("text")))
    for i, j in tb.slices(offsets):
        at, part = offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]
        starts, ends, first = tb.word_spans(part, at, tb.NOT_SPACE)
        hashes, begin = tb.shingles(tb.word_hashes(part, starts, ends), first, SHINGLE)
        sets = [np.unique(hashes[a:b]) for a, b in zip(begin[:-1], begin[1:])]
        yield i, j, np.concatenate(sets) if sets else hashes[:0], np.concatenate(([0], np.cumsum([len(s) for s in sets])))


def _set_digest(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits and the size of each set of shingles."""
    n = np.diff(at)
    one, two = np.zeros(len(n), _U), np.zeros(len(n), _U)
    heads = at[:-1][n > 0]
    if len(heads):
        one[n > 0], two[n > 0] = np.bitwise_xor.reduceat(x, heads), np.add.reduceat(tb.mix(x), heads)
    return one, two, n


@lean
def _digest(batches):
    """Each document's set size and 128-bit set digest; those of a class of their own are sketched later, from one member."""
    for batch in batches:
        ids, sizes, ones, twos, sigs, odds = batch.column(batch.schema.get_field_index("doc_id")), [], [], [], [], []
        for _, _, x, at in _sets(batch):
            one, two, n = _set_digest(x, at)
            has = n > 0
            sig, odd = np.zeros((len(n), PLACES), "<u2"), np.zeros((len(n), ODD_BITS // 8), np.uint8)
            if len(x):
                heads = at[:-1][has]
                for k in range(PLACES):
                    sig[has, k] = (np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], heads) >> _U(40)).astype("<u2")
                place = (x >> _U(7)) % _U(ODD_BITS)
                row = np.repeat(np.arange(len(n)), n)
                odd = np.packbits((np.bincount(row * ODD_BITS + place.astype(np.int64), minlength=len(n) * ODD_BITS) & 1).astype(np.uint8).reshape(len(n), ODD_BITS), axis=1)
            sizes.append(n)
            ones.append(one.view(np.int64))
            twos.append(two.view(np.int64))
            sigs += [r.tobytes() for r in sig]
            odds += [r.tobytes() for r in odd]
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(cat(sizes)), pa.array(cat(ones)), pa.array(cat(twos)), pa.array(sigs, pa.binary()), pa.array(odds, pa.binary())], names=["doc_id", "n", "d1", "d2", "sig", "odd"])


@lean
def _keys(batches):
    """The keys of each class: per chunk, each choice of all but one of its places."""
    for batch in batches:
        cls = batch.column(0).to_numpy()
        if not len(cls):
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(cls), PLACES).astype(_U)
        keys, marks = [], []
        for c in range(CHUNKS):
            for out in range(CHUNK):
                a, b, d, e = (sig[:, c * CHUNK + k] for k in range(CHUNK) if k != out)
                keys.append(tb.mix((a | b << _U(16) | d << _U(32) | e << _U(48)) ^ _SALT[c * CHUNK + out]))
                marks.append(np.full(len(cls), c * CHUNK + out, np.int16))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(cls, PLACES)), pa.array(np.concatenate(marks))], names=["key", "cls", "mark"])


def _most_odd(n: np.ndarray) -> np.ndarray:
    """How many bits two odd sketches may differ in, for sets of n shingles together that reach the threshold.

    The symmetric difference is at most (100 - p) / (100 + p) of n, and no sketch differs in more bits than that.
    For large sets, whose shingles share bits, the expected count plus six deviations is the lower bound.
    """
    most = n * ((100 - PERCENT) / (100 + PERCENT))
    mean = ODD_BITS / 2 * (1 - np.exp(-2 * most / ODD_BITS))
    return np.minimum(most + 1e-9, mean + 6 * np.sqrt(ODD_BITS / 4) + 1)


@lean
def _meet(batches):
    """Pairs of different components within sorted runs of (key, low, high) that may reach the threshold."""

    def pairs(t: pa.Table):
        low, high, block = (t[c].to_numpy() for c in ("low", "high", "block"))
        key, cls, root, n, mark = (t[c].to_numpy() for c in ("key", "cls", "root", "n", "mark"))
        rows = len(key)
        if not rows:
            return
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(rows, PLACES)
        odd = np.frombuffer(b"".join(t["odd"].to_pylist()), np.uint64).reshape(rows, ODD_BITS // 64)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
        for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [rows]))):
            if b - a < 2:
                continue
            if low[a] == high[a]:
                i, j = np.triu_indices(b - a, 1)
            else:
                left, right = np.flatnonzero(block[a:b] == low[a]), np.flatnonzero(block[a:b] == high[a])
                i, j = np.repeat(left, len(right)), np.tile(right, len(left))
            i, j = i + a, j + a
            ok = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(odd[i] ^ odd[j]).sum(1) <= _most_odd((n[i] + n[j]).astype(float))
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            same = sig[i].reshape(len(i), CHUNKS, CHUNK) == sig[j].reshape(len(i), CHUNKS, CHUNK)
            good = same.sum(2) >= CHUNK - 1
            first = good.argmax(1)
            miss = np.where(same[np.arange(len(i)), first].all(1), 0, (~same[np.arange(len(i)), first]).argmax(1))
            ok = first * CHUNK + miss == mark[i]  # a pair that shares several keys counts at the first only
            i, j = i[ok], j[ok]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j])), pa.array(np.minimum(root[i], root[j])), pa.array(np.maximum(root[i], root[j]))], names=["a", "b", "ra", "rb"])

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        key, low, high = (t[c].to_numpy() for c in ("key", "low", "high"))
        change = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        if len(change):
            yield from pairs(t.slice(0, change[-1] + 1))
            t = t.slice(change[-1] + 1)
        rest = t
    if rest is not None:
        yield from pairs(rest)


def _confirmed(pairs: DataFrame, docs: DataFrame, rows: int) -> DataFrame:
    """Of the pairs (a, b) of classes, those whose full sets reach the threshold; rows: about how many the shuffles of these pairs and sets are worth."""
    slim = lambda df: fewer(df, rows)
    bits = bits_of(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), "cls")

    @lean
    def sets(batches):
        """The sets of documents whose id may be asked for; only those are shuffled."""
        for batch in batches:
            marked = batch.filter(batch.column(2))
            for i, j, x, at in _sets(marked):
                one, two, n = _set_digest(x, at)
                yield pa.RecordBatch.from_arrays([marked.column(0).slice(i, j - i), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.view(np.int64)))], names=["cls", "n", "d1", "d2", "set"])

    words = np.frombuffer(bits, np.int64)
    spark = docs.sparkSession
    # the bitmap is at most 1 MiB; as a column it would be copied with every plan, so it goes as a table of words
    held = F.broadcast(spark.createDataFrame(pa.table({"w": pa.array(np.flatnonzero(words).astype(np.int32)), "bits": pa.array(words[words != 0])})))
    size = len(words) * 64
    near = docs.join(held, F.expr(f"cast(pmod(xxhash64(doc_id), {size}L) / 64 as int)") == F.col("w"), "left").select("doc_id", "text", F.expr("coalesce(bits & shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int)) <> 0, false)").alias("near"))
    whole = near.where("near").mapInArrow(sets, "cls long, n long, d1 long, d2 long, set array<long>").dropDuplicates(["cls", "n", "d1", "d2"]).select("cls", "set")
    whole = slim(whole)

    # partners of a leader of many are dealt to blocks; leaders and blocks of such are at most 2 * HOT
    counts = saved(slim(pairs.groupBy("a").agg(F.count("*").alias("n"))), "leaders")
    share = max(BLOCK, (counts.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.broadcast(counts.where(F.col("n") > share).select("a", F.ceil(F.col("n") / share).cast("int").alias("blocks")))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.coalesce(F.expr("cast(pmod(xxhash64(b, 5), blocks) as int)"), F.lit(0)).alias("part"))
    left = whole.select(F.col("cls").alias("a"), F.col("set").alias("sa")).join(hot, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    right = slim(dealt.join(whole.select(F.col("cls").alias("b"), F.col("set").alias("sb")), "b"))
    both = right.join(left, ["a", "part"]).withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return slim(slim(both.where(f"100 * i >= {PERCENT} * (size(sa) + size(sb) - i)").select("a", "b")).distinct())


def _apart(pairs: DataFrame, roots: DataFrame, rows: int) -> DataFrame:
    """pairs(a, b, ra, rb) with the roots that ra and rb have now, without those that are in one component."""
    for c in ("ra", "rb"):
        now = pairs.groupBy(c).agg(F.count("*").alias("n")).join(roots.select(F.col("node").alias(c), "root"), c)
        pairs = fewer(hot_join(pairs, saved(fewer(now, rows), "roots-now"), c, how="left"), rows).withColumn(c, F.coalesce("root", c)).select("a", "b", "ra", "rb")
    return pairs.where("ra <> rb").select("a", "b", F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"))


_SET = ["n", "d1", "d2"]


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents(doc_id, text, ...); see the module's text."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = saved(docs.mapInArrow(_digest, "doc_id long, n long, d1 long, d2 long, sig binary, odd binary"), "digest")
    # the most rows that a shuffle has but for pairs: a class's keys
    rows_of = PLACES * digest.count()
    kept = lambda df, name: saved(fewer(df, rows_of), name)
    named = digest.where("n > 0 and doc_id is not null")
    classes = kept(named.groupBy(*_SET).agg(F.min("doc_id").alias("cls"), F.count("*").alias("many")), "classes")
    # a document with several texts may name several classes
    sketch = kept(named.join(classes.select(*_SET, F.col("cls").alias("doc_id")), [*_SET, "doc_id"], "left_semi").dropDuplicates(_SET).select(F.col("doc_id").alias("cls"), "n", "sig", "odd"), "sketch")
    keys = sketch.select("cls", "sig").mapInArrow(_keys, "key long, cls long, mark short")

    # buckets with several members, and in each the smallest as leader
    leads = kept(keys.groupBy("key").agg(F.min("cls").alias("lead"), F.max("cls").alias("top"), F.count("*").alias("n")).where("lead <> top").select("key", "lead", "n"), "leads")
    bucket = kept(hot_join(keys, leads, "key").drop("n"), "buckets")
    first = kept(_confirmed(kept(bucket.where("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct(), "pairs"), docs, rows_of), "links")
    # one document with several texts: all its classes are one
    of = kept(hot_join(named.select("doc_id", *_SET), classes, _SET, "many").select("doc_id", "n", "cls"), "assigned")
    again = of.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a <> z")
    same = of.select("doc_id", F.col("cls").alias("b")).join(again.select("doc_id", "a"), "doc_id").select("a", "b").where("a <> b").distinct()
    links = first.union(same)
    roots = kept(components(links, rows_of), "roots")

    rooted = bucket.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "mark", F.coalesce("root", "cls").alias("root"))
    rooted = kept(rooted, "rooted")
    per = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = per.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select("key", "size", F.col("top.root").alias("major"), blocks(F.col("size") - F.col("top.n")).alias("minors"), blocks(F.col("top.n")).alias("majors"))
    rows = hot_join(rooted, kept(mixed, "mixed"), "key", "size")
    # blocks of strays come first, those of the largest component after them; each of these meets the strays only
    rows = rows.withColumn("block", F.expr("if(root = major, minors + cast(pmod(xxhash64(cls, 3), majors) as int), cast(pmod(xxhash64(cls, 3), minors) as int))"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, if(root = major, minors, minors + majors) - 1)"))).select("key", "cls", "mark", "root", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = fewer(rows.join(sketch, "cls"), rows_of)
    order = ["key", "low", "high"]
    second = kept(fewer(rows.repartition(*order), rows_of).sortWithinPartitions(*order).mapInArrow(_meet, "a long, b long, ra long, rb long").distinct(), "pairs")
    for k in range(ROUNDS):
        n = second.count()
        if not n:
            break
        sides = second.select(F.col("ra").alias("c"), "a", "b").unionByName(second.select(F.col("rb").alias("c"), "a", "b"))
        tries = kept(sides.groupBy("c", F.expr(f"pmod(xxhash64(a, b, 11), {TRIES})").alias("try")).agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.a", "pair.b").distinct(), "tries")
        # a round that leaves out less than half of the pairs saves nothing
        last = k == ROUNDS - 1 or n <= 2 * tries.count()
        links = links.union(kept(_confirmed(second.select("a", "b").distinct() if last else tries, docs, rows_of), "links"))
        roots = kept(components(links, rows_of), "roots")
        if last:
            break
        second = kept(_apart(second, roots, rows_of), "pairs")
    # a class is named after its smallest doc_id, so the smallest node of a component is the smallest doc_id
    sizes = classes.groupBy("cls").agg(F.sum("many").alias("many")).join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "many", F.coalesce("root", "cls").alias("component_id"))
    found = hot_join(of, kept(sizes, "components"), "cls", "many").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = digest.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each group of near copies: those with a near copy of a smaller doc_id go; rows and columns are as they came.

    Copies that doc_ids don't tell apart go too: of rows with the same doc_id and text one stays, and of rows without a doc_id and with the same text one, or none where a row with a doc_id has that text (by SHA-256).
    Rows of one doc_id with different texts go or stay together; rows whose text has no words are copies of nothing.
    """
    gone = near_duplicates(documents).where("not kept").select("doc_id").distinct()
    text = F.col("row.text").cast("string")
    rows = documents.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("id"), text.alias("text"))
    rows = rows.join(gone, F.col("id") == F.col("doc_id"), "left_anti").drop("doc_id")
    ids = documents.select(F.col("doc_id").cast("long").alias("id"))
    repeated = saved(ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id"), "repeated-ids")
    if is_empty(repeated):
        return rows.select("row.*")
    own = repeated.select(F.col("id").alias("of"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    many = saved(rows.join(own, F.col("id").eqNullSafe(F.col("of")), "left_semi").where(worded).withColumn("same", F.sha2("text", 256)).withColumn("at", F.monotonically_increasing_id()), "repeated-rows")
    first = many.groupBy("id", "same").agg(F.min("at").alias("at"))
    named = rows.where(worded).where("id is not null").select(F.sha2("text", 256).alias("same")).distinct()
    nameless = first.where("id is null").join(named, "same", "left_anti").select("at")
    stays = many.join(first.where("id is not null").select("at").union(nameless), "at", "left_semi")
    alone = rows.join(own, F.col("id").eqNullSafe(F.col("of")), "left_anti")
    wordless = rows.where(~worded).join(own, F.col("id").eqNullSafe(F.col("of")), "left_semi")
    return alone.select("row.*").unionByName(stays.select("row.*")).unionByName(wordless.select("row.*"))
