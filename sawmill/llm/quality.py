"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

A text is a row of runs of letters, digits or other signs. Each run has a word symbol (its lower-cased bytes hashed to one
of ``WORDS``) and a shape symbol (kind, case, length, or that it repeats the run before). Every symbol has a sparse ternary index vector of ``DIM``
numbers; over all documents, a symbol's context vector is the sum of the index vectors of its neighbours. These counts are
whole numbers summed by task and then by block of symbols, so they don't depend on the order of the work, and the model
has a fixed size. A document's features are the means of the unit context vectors of its symbols, and of the
index vectors of its shapes, with its number of runs.

The network learns from at most ``SAMPLE`` labelled documents, those with the smallest hashes of their ids, in the same number of steps whatever their number; a
fifth of them is kept for the temperature, by which logits are divided. Without rows of both labels every score is the share of label 1 (0.5 without rows).

Defined cases: null text is empty; an empty text has features of zero and a score like any other; a null doc_id is scored and
not held out; of several labels of one doc_id the lowest counts, and of several texts of a labelled doc_id the smallest is learned from; every row is scored by its
own text, and so kept or rejected, whatever other rows have its doc_id; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.llm import textbytes as tb
from sawmill.llm.common import lean, small_batches

WORDS, SHAPES, DIM, NONZERO = 8192, 256, 32, 2
SYMBOLS = WORDS + SHAPES
BLOCK = 128  # symbols in a row of the summed model
SAMPLE = 20_000
HIDDEN, STEPS, BATCH, RATE, DECAY = 32, 10_000, 64, 2e-3, 1e-3
THRESHOLD = 0.7
FEATURES = 3 * DIM + 1

_KIND = np.zeros(256, np.int64)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[10] = 3  # an end of line is a sign of its own
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_PLACE = (tb._splitmix(SYMBOLS * NONZERO, 301) % np.uint64(DIM)).astype(np.int64).reshape(SYMBOLS, NONZERO)
_SIGN = np.where(tb._splitmix(SYMBOLS * NONZERO, 302) & np.uint64(1), 1.0, -1.0).reshape(SYMBOLS, NONZERO)


def _symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and shape symbols of all runs, and each row's first run."""
    kind = _KIND[raw]
    first, last = kind > 0, kind > 0
    if len(raw):
        change = kind[1:] != kind[:-1]
        first[1:] &= change
        last[:-1] &= change
        rows = offsets[:-1] < offsets[1:]
        heads, tails = offsets[:-1][rows], offsets[1:][rows] - 1
        first[heads], last[tails] = kind[heads] > 0, kind[tails] > 0
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return starts, starts, np.zeros(len(offsets), np.int64)
    upper = np.concatenate(([0], np.cumsum(_UPPER[raw])))
    length, capital = ends - starts, upper[ends] - upper[starts]
    case = np.where(capital == 0, 0, np.where(capital == length, 3, np.where((capital == 1) & (_UPPER[raw[starts]] == 1), 1, 2)))
    shape = kind[starts] * 64 + case * 16 + np.minimum(length, 15)
    hashes = tb.word_hashes(raw, starts, ends)
    word = np.where(kind[starts] == 2, np.minimum(length, 15), (hashes % np.uint64(WORDS)).astype(np.int64))
    row = np.searchsorted(starts, offsets)
    again = np.zeros(len(word), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[row[:-1][row[:-1] < row[1:]]] = False
    shape[again] = np.minimum(length[again], 15)  # a run that repeats the one before
    return word, shape + WORDS, row


def contexts(documents: DataFrame) -> np.ndarray:
    """The context vectors (SYMBOLS x DIM) over all documents; what a task sends is bounded by the size of the model."""

    @lean
    def count(batches):
        total = np.zeros(SYMBOLS * DIM)
        for batch in batches:
            raw, offsets = tb.text_buffer(batch.column(0))
            for i, j in tb.slices(offsets):
                word, shape, first = _symbols(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if len(word) < 2:
                    continue
                inner = np.ones(len(word), bool)
                inner[first[:-1][first[:-1] < first[1:]]] = False
                right = np.flatnonzero(inner)
                for here, there in ((right, right - 1), (right - 1, right)):
                    for centre, near in ((word, word), (word, shape), (shape, shape)):
                        at, of = centre[here] * DIM, near[there]
                        for k in range(NONZERO):
                            total += np.bincount(at + _PLACE[of, k], _SIGN[of, k], minlength=SYMBOLS * DIM)
        parts = total.astype(np.int64).reshape(-1, BLOCK * DIM)
        rows = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array([parts[r].tobytes() for r in rows], pa.binary())], names=["block", "part"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(part, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "part"])

    schema = "block int, part binary"
    out = np.zeros((SYMBOLS // BLOCK, BLOCK * DIM), np.int64)
    texts = documents.select(F.col("text").cast("string").alias("text"))
    for block, part in texts.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():
        out[block] = np.frombuffer(bytes(part), np.int64)
    return out.reshape(SYMBOLS, DIM)


class Pool:
    """Features of texts: what the symbols' vectors give, pooled by document."""

    def __init__(self, vectors: np.ndarray):
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.words = (vectors / np.maximum(size, 1)).astype(np.float32)
        index = np.zeros((SHAPES, DIM), np.float32)
        for k in range(NONZERO):
            np.add.at(index, (np.arange(SHAPES), _PLACE[WORDS:, k]), _SIGN[WORDS:, k].astype(np.float32))
        self.shapes = np.concatenate((self.words[WORDS:], index), axis=1)

    def features(self, texts: pa.Array):
        """(rows i..j, their features) of a text column, a slice at a time."""
        raw, offsets = tb.text_buffer(texts)
        for i, j in tb.slices(offsets):
            word, shape, first = _symbols(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = np.diff(first)
            out = np.zeros((j - i, FEATURES), np.float32)
            has = np.flatnonzero(n)
            if len(has):
                out[has, :DIM] = np.add.reduceat(self.words[word], first[:-1][has], axis=0) / n[has, None]
                doc = np.repeat(np.arange(j - i), n)
                table = np.bincount(doc * SHAPES + shape - WORDS, minlength=(j - i) * SHAPES).reshape(j - i, SHAPES)
                out[:, DIM:-1] = table.astype(np.float32) @ self.shapes / np.maximum(n, 1)[:, None]
                out[:, -1] = np.log1p(n)
            yield i, j, out.astype(float)


class Network:
    """Standardised inputs, one tanh layer, one logit, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.flat = len(y) == 0 or self.prior in (0.0, 1.0)
        if self.flat:
            return
        order = rng.permutation(len(y))
        test, train = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        d = x.shape[1]
        p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        parts = max(1, len(train) // BATCH)
        for _ in range(-(-STEPS // parts)) if len(train) else ():
            for at in np.array_split(rng.permutation(train), parts):
                h = np.tanh(x[at] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[at]) / len(at)
                gh = np.outer(g, p[2]) * (1 - h * h)
                grads = [x[at].T @ gh + DECAY * p[0], gh.sum(0), h.T @ g + DECAY * p[2], np.array([g.sum()])]
                t += 1
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if len(test) > 1:
            z = self._logits(x[test])
            loss = lambda s: float(np.mean(np.logaddexp(0, -(2 * y[test] - 1) * z / s)))
            self.temperature = float(min(np.geomspace(0.5, 5, 61), key=loss))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.prior)
        z = self._logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is for tests only: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def trained(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Pool, Network]:
    """Word vectors of all documents, and the network of at most ``sample`` labelled ones; labels of rows held out aren't read."""
    spark = documents.sparkSession
    small_batches(spark)
    pool = Pool(contexts(documents))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    small = F.broadcast(spark.createDataFrame(pa.Table.from_pandas(chosen.astype("int64"), preserve_index=False)))  # at most ``sample`` rows
    # at most ``sample`` texts
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(small, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    sent = spark.sparkContext.broadcast(pool)

    @lean
    def pooled(batches):
        for batch in batches:
            for i, j, f in sent.value.features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in f], pa.binary()), batch.column(2).slice(i, j - i)], names=["doc_id", "f", "quality"])

    train = texts.mapInArrow(pooled, "doc_id long, f binary, quality long").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(bytes(f) for f in train["f"]), float).reshape(-1, FEATURES)
    return pool, Network(x, train["quality"].to_numpy().astype(float))


def quality_scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of documents."""
    sent = documents.sparkSession.sparkContext.broadcast(trained(documents, labels, sample))

    @lean
    def score(batches):
        pool, network = sent.value
        for batch in batches:
            for i, j, f in pool.features(batch.column(1)):
                p = network.score(f)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(score, "doc_id long, score double, predicted int").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without the rows predicted as 0; rows and columns as they came, in one pass and without a join.

    Without labels of both kinds nothing was learned, and no row goes.
    """
    sent = documents.sparkSession.sparkContext.broadcast(trained(documents, labels))

    @lean
    def keep(batches):
        pool, network = sent.value
        for batch in batches:
            good = [(network.score(f) >= THRESHOLD) | network.flat for _, _, f in pool.features(batch.column(batch.schema.get_field_index("text")))]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return documents.mapInArrow(keep, documents.schema)
