"""Benchmark decontamination: an FM-index for each shard of training text, searched for the test phrases.

A shard is up to ``SHARD`` bytes of consecutive documents of a task. Its words become symbols; a word that no test
phrase holds cannot be part of an occurrence, so the indexed text consists of the stretches of known words that are
long enough for the shortest phrase, each closed by a mark. Phrases (``WINDOW`` consecutive words of an item, or all
words of a shorter item) are found by backward search, located through sampled suffix positions and merged to spans.

Items are read in blocks of at most ``BLOCK`` bytes of text (or of one item); each block is a pass over the documents, so what is sent
to the executors is bounded whatever the size of the benchmark. What is found or removed doesn't depend on how items fall into blocks.

Defined cases: null text has no words; items without words or with a null item_id are left out; rows of one item_id are
one item; a null doc_id is carried through; empty tables give no contaminated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.llm import textbytes as tb
from sawmill.llm.common import is_empty, lean, saved, small_batches
from sawmill.llm.fmindex import FMIndex

WINDOW = 10
SHARD = 8 << 20
BLOCK = 1 << 20

_MARK = 1  # closes a stretch; words have symbols from 2


class Phrases:
    """The test phrases of a block of items as rows of symbols, by length, with the items that hold each."""

    def __init__(self, items: list[tuple[int, str]]):
        raw, offsets = tb.text_buffer(pa.array([t for _, t in items], pa.string()))
        starts, ends, first = tb.word_spans(raw, offsets, tb.ALNUM)
        hashes = tb.word_hashes(raw, starts, ends)
        self.words, symbols = np.unique(hashes, return_inverse=True)
        symbols = symbols.astype(np.int64) + 2
        found: dict[int, dict[bytes, set[int]]] = {}
        for (item, _), a, b in zip(items, first[:-1], first[1:]):
            size = min(WINDOW, b - a)
            for i in range(a, b - size + 1) if size else ():
                found.setdefault(int(size), {}).setdefault(symbols[i : i + size].astype(np.int32).tobytes(), set()).add(item)
        self.tables = {}
        for size, rows in found.items():
            at = np.concatenate(([0], np.cumsum([len(x) for x in rows.values()])))
            self.tables[size] = (np.frombuffer(b"".join(rows), np.int32).reshape(-1, size), at, np.array([i for x in rows.values() for i in sorted(x)], np.int64))
        self.least = min(self.tables, default=0)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 for unknown ones."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.words):
            maybe = np.flatnonzero(self.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
            out[maybe] = np.where(self.words[at] == hashes[maybe], at + 2, 0)
        return out


class Shard:
    """Documents whose known stretches wait for an index."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.parts, self.places, self.count, self.bytes = phrases, [], [], 0, 0
        self.firsts: list[np.ndarray] = []  # first word of each document
        self.spans: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, raw: np.ndarray, offsets: np.ndarray, keep_spans: bool = False) -> np.ndarray:
        """Takes documents; returns their numbers of words."""
        starts, ends, first = tb.word_spans(raw, offsets, tb.ALNUM)
        known = self.phrases.symbols(tb.word_hashes(raw, starts, ends))
        head = np.zeros(len(known), bool)
        head[first[:-1][first[:-1] < first[1:]]] = True
        cut = head | (known == 0)
        cut[1:] |= known[:-1] == 0
        begin = np.flatnonzero(cut)
        length = np.diff(np.append(begin, len(known)))
        good = (known[begin] > 0) & (length >= max(1, self.phrases.least)) if len(begin) else np.zeros(0, bool)
        begin, length = begin[good], length[good]
        at = np.concatenate(([0], np.cumsum(length + 1)))
        index = np.repeat(begin - at[:-1], length + 1) + np.arange(at[-1])
        marks = at[1:] - 1
        index[marks] = 0
        text = known[index] if len(index) else np.zeros(0, np.int64)
        text[marks] = _MARK
        self.parts.append(text)
        self.places.append(index + self.count)
        self.firsts.append(first[:-1] + self.count)
        if keep_spans:
            self.spans.append((starts, ends))
        self.count += len(known)
        self.bytes += len(raw)
        return np.diff(first)

    def found(self) -> tuple[np.ndarray, dict[int, set[int]], np.ndarray]:
        """(whether each word is hit, the items found by document, each document's first word with the end added)."""
        firsts = np.append(np.concatenate(self.firsts) if self.firsts else np.zeros(0, np.int64), self.count)
        change = np.zeros(self.count + 1, np.int64)
        items: dict[int, set[int]] = {}
        text = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        if len(text) and self.phrases.tables:
            places, index = np.concatenate(self.places), FMIndex(text, len(self.phrases.words) + 1)
            for size, (rows, at, owners) in self.phrases.tables.items():
                low, high = index.search(rows)
                hit = np.flatnonzero(high > low)
                n = (high - low)[hit]
                if not len(hit):
                    continue
                of = np.repeat(np.arange(len(hit)), n)
                suffix = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[hit][of]
                word = places[index.locate(suffix)]
                np.add.at(change, word, 1)
                np.add.at(change, word + size, -1)
                doc = np.searchsorted(firsts, word, "right") - 1
                for pair in np.unique(doc * len(rows) + hit[of]).tolist():
                    d, p = divmod(pair, len(rows))
                    items.setdefault(d, set()).update(owners[at[p] : at[p + 1]].tolist())
        return np.cumsum(change[:-1]) > 0, items, firsts


def _runs(hit: np.ndarray) -> np.ndarray:
    """(begin, end) of runs of hit words, as rows."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    for item, text in rows.toLocalIterator():
        more = len(text.encode())
        if block and size + more > BLOCK:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += more
    yield block


SPANS = "doc_id long, text_key long, n_words long, spans array<int>, items array<long>"


def _pass(documents: DataFrame, items: list[tuple[int, str]], whole: bool) -> DataFrame:
    """Hit spans (begin and end word, flat) and items by document; without ``whole`` only of hit ones."""
    sent = documents.sparkSession.sparkContext.broadcast(Phrases(items))

    @lean
    def scan(batches):
        phrases = sent.value

        def finish(shard, ids, keys, counts):
            hit, items, firsts = shard.found()
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            spans = [[]] * len(n)
            for d in items:
                spans[d] = _runs(hit[firsts[d] : firsts[d + 1]]).ravel().tolist()
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(keys), pa.array(n), pa.array(spans, pa.list_(pa.int32())), pa.array([sorted(items.get(d, ())) for d in range(len(n))], pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_words", "spans", "items"])
            return out if whole else out.filter(pa.array([d in items for d in range(len(n))], pa.bool_()))

        shard, ids, keys, counts = Shard(phrases), [], [], []
        for batch in batches:
            raw, offsets = tb.text_buffer(batch.column(2))
            for i, j in tb.slices(offsets):
                counts.append(shard.add(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                ids.append(batch.column(0).slice(i, j - i))
                keys.append(batch.column(1).slice(i, j - i))
                if shard.bytes >= SHARD:
                    yield finish(shard, ids, keys, counts)
                    shard, ids, keys, counts = Shard(phrases), [], [], []
        if ids:
            yield finish(shard, ids, keys, counts)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scan, SPANS)


def _merged(rows: DataFrame) -> DataFrame:
    """Digest columns of rows of SPANS."""

    def digest(batches):
        for batch in batches:
            n_hit, n_items, sha, merged = [], [], [], []
            for spans, items in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                pairs, out = sorted(zip(spans[::2], spans[1::2])), []
                for a, b in pairs:
                    if out and a <= out[-1]:
                        out[-1] = max(out[-1], b)
                    else:
                        out += [a, b]
                ids = sorted(map(str, set(items)))
                merged.append(out)
                n_hit.append(sum(out[1::2]) - sum(out[::2]))
                n_items.append(len(ids))
                sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(merged, pa.list_(pa.int32()))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return rows.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of documents: n_words, n_hit, n_items, items_sha256, contaminated, spans (begin and end words, flat)."""
    small_batches(documents.sparkSession)
    rows = more = None
    for block in _blocks(benchmark):
        if rows is None:
            rows = _pass(documents, block, True)
        else:
            one = _pass(documents, block, False)
            more = one if more is None else more.union(one)
    if more is not None:
        joined = more.dropDuplicates(["doc_id", "text_key", "spans", "items"]).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i")).withColumnsRenamed({"doc_id": "d", "text_key": "k"})
        none = F.array().cast("array<int>")
        rows = rows.join(joined, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select("doc_id", "text_key", "n_words", F.concat("spans", F.coalesce("s", none)).alias("spans"), F.concat("items", F.coalesce("i", none.cast("array<long>"))).alias("items"))
    return _merged(rows)


def without_benchmark(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents with the hit spans cut out of text, again and again until no phrase is left; other columns as they came.

    In each round the spans of all phrases are found in the same text, and their union is cut. With several blocks of items a round is a pass for
    each block, and the next round reads only the documents that were cut. A column n_chars, where there is one, follows the new text.
    """
    spark = documents.sparkSession
    small_batches(spark)
    blocks = _blocks(benchmark)
    first, more = next(blocks), next(blocks, None)
    if more is None:
        return documents.mapInArrow(_cutter(spark.sparkContext.broadcast(Phrases(first))), documents.schema)
    todo, clean = documents.select(F.struct("*").alias("row")), None
    while True:
        rows, hits = todo.select("row.*"), None
        for block in _blocks(benchmark):
            one = saved(_pass(rows, block, False).select("doc_id", "text_key", "spans"), "spans")
            hits = one if hits is None else hits.union(one)
        # spans of one text, which bounds their number
        merged = hits.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("spans")).alias("spans"))
        of = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("text_key"))
        left = todo.join(merged, of, "left_anti").select("row.*")
        clean = left if clean is None else clean.union(left)
        if is_empty(hits):
            return clean
        cut = todo.join(merged, of).select("row.*", F.col("spans").alias(SPANS_COLUMN)).mapInArrow(_cut_spans, documents.schema)
        todo = saved(cut.select(F.struct("*").alias("row")), "cut")


#: The last column of what _cut_spans takes, whatever other columns are named.
SPANS_COLUMN = "spans of words to cut"


def _replaced(batch: pa.RecordBatch, new: dict[int, str]) -> list[pa.Array]:
    """The columns of a batch with the new texts of rows, and their lengths in n_chars."""
    columns, k = list(batch.columns), batch.schema.get_field_index("text")
    if new:
        columns[k] = pa.array([new.get(d, t) for d, t in enumerate(columns[k].to_pylist())], batch.schema.field(k).type)
        if (c := batch.schema.get_field_index("n_chars")) >= 0:
            columns[c] = pa.array([len(new[d]) if d in new else n for d, n in enumerate(columns[c].to_pylist())], batch.schema.field(c).type)
    return columns


@lean
def _cut_spans(batches):
    """Rows with the words of their last column (begin and end, flat) cut out of text; the column goes."""
    for batch in batches:
        raw, offsets = tb.text_buffer(batch.column(batch.schema.get_field_index("text")))
        spans, new = batch.column(batch.num_columns - 1).to_pylist(), {}
        for i, j in tb.slices(offsets, SHARD):
            starts, ends, first = tb.word_spans(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tb.ALNUM)
            for d in range(i, j):
                text = raw[offsets[d] : offsets[d + 1]]
                keep = np.ones(len(text), bool)
                for a, b in zip(spans[d][::2], spans[d][1::2]):
                    at = first[d - i]
                    keep[starts[at + a] - (offsets[d] - offsets[i]) : ends[at + b - 1] - (offsets[d] - offsets[i])] = False
                new[d] = text[keep].tobytes().decode()
        columns = _replaced(batch, new)[:-1]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def _cutter(sent):
    @lean
    def clean(batches):
        phrases = sent.value
        for batch in batches:
            k = batch.schema.get_field_index("text")
            raw, offsets = tb.text_buffer(batch.column(k))
            new: dict[int, bytes] = {}
            for i, j in tb.slices(offsets, SHARD):
                todo, texts = list(range(i, j)), [raw[offsets[d] : offsets[d + 1]] for d in range(i, j)]
                while todo:
                    shard = Shard(phrases)
                    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
                    part = np.concatenate(texts)
                    for a, b in tb.slices(ends):
                        shard.add(part[ends[a] : ends[b]], ends[a : b + 1] - ends[a], keep_spans=True)
                        shard.spans[-1] = tuple(x + ends[a] for x in shard.spans[-1])
                    hit, items, firsts = shard.found()
                    starts, stops = (np.concatenate(x) for x in zip(*shard.spans))
                    again, left = [], []
                    for d in sorted(items):
                        keep, at = np.ones(ends[d + 1] - ends[d], bool), ends[d]
                        for a, b in _runs(hit[firsts[d] : firsts[d + 1]]):
                            keep[starts[firsts[d] + a] - at : stops[firsts[d] + b - 1] - at] = False
                        text = part[ends[d] : ends[d + 1]][keep]
                        new[todo[d]] = text.tobytes()
                        again.append(todo[d])
                        left.append(text)
                    todo, texts = again, left
            yield pa.RecordBatch.from_arrays(_replaced(batch, {d: t.decode() for d, t in new.items()}), names=batch.schema.names)

    return clean
