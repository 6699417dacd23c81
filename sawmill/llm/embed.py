"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, and a rerank by the vectors themselves.

The rotation is learned on at most ``SAMPLE`` vectors, those with the smallest hashes of their ids; every vector is coded and indexed.
A code of b bits is cut into m chunks, m being what costs least for the number of vectors. Codes within ``RADIUS`` bits agree in some chunk up to RADIUS // m
bits, so each vector is put into the tables under its own chunk values and probes those that differ in so many bits. Of two
vectors the one with the larger chunk value probes, and a pair counts in its first chunk only: it comes up once. Buckets are
dealt in pairs of bounded blocks. Pairs within RADIUS are confirmed by their cosine in double precision.

Equal vectors of a label are one class; classes are linked, and their sizes give the numbers of links.

RADIUS: two vectors at a cosine of 0.93 differ by 21.6 degrees, so each of 64 bits differs with a probability of about 0.12; 11 bits
hold 0.92 of such pairs, and more of all closer ones (recall against brute force is measured in the tests and the README).

Defined cases: vectors that are null, zero, or hold nulls or non-finite numbers, null labels and null vec_ids link with nothing (component_id is
the vec_id, kept true); vectors of different lengths don't link; repeated rows are linked copies; rows of one vec_id with
different vectors are compared like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.llm.common import by_shuffle, components, in_blocks, saved, whole_runs

LEAST = 0.93
SAMPLE = 20_000
BITS, RADIUS, ROUNDS = 64, 11, 50
BLOCK = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors as rows, padded with zeros to the longest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max()) if len(sizes) else 0))
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out /= np.maximum(np.abs(out).max(axis=1, initial=0, keepdims=True), np.finfo(float).smallest_subnormal)  # so that no square overflows or vanishes
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.finfo(float).tiny)


class Quantiser:
    """Signs of centred vectors in a rotated space of leading principal directions."""

    def __init__(self, x: np.ndarray, bits: int = BITS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean = x.mean(0)
        centred = x - self.mean
        _, directions = np.linalg.eigh(centred.T @ centred)
        self.map = directions[:, ::-1][:, :bits]
        z = centred @ self.map
        rotation = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(z @ rotation > 0, 1.0, -1.0).T @ z)
            rotation = (u @ v).T
        self.map, self.bits = self.map @ rotation, z.shape[1]

    def codes(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] < len(self.mean):
            x = np.pad(x, ((0, 0), (0, len(self.mean) - x.shape[1])))
        on = ((x[:, : len(self.mean)] - self.mean) @ self.map > 0).astype(np.uint64)
        return (on << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _chunks(bits: int, n: int, radius: int) -> list[tuple[int, int]]:
    """(shift, width) of each chunk, for the number of chunks that costs least.

    With m chunks a vector probes all values within radius // m bits of each chunk, and meets there a share of the n vectors of its label.
    """

    def cost(m: int) -> float:
        width = bits / m
        probes = sum(math.comb(round(width), k) for k in range(radius // m + 1))
        return m * probes * (1 + n / 2**width)

    m = min(range(1, bits + 1), key=cost)
    at = [bits * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def near_vectors(embeddings: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of embeddings(vec_id, embedding, label, ...)."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    usable = "vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = rows.withColumn("usable", F.coalesce(F.expr(usable), F.lit(False)))
    rows = rows.withColumn("cls", F.when(F.col("usable"), F.xxhash64("label", "embedding")))
    classes = saved(rows.where("usable").groupBy("cls").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"), F.first("embedding").alias("embedding"), F.first("label").alias("label")), "classes")
    sample = classes.orderBy(F.xxhash64("cls", F.lit(1)), "cls").limit(SAMPLE).select("embedding").toArrow()
    links = None
    if len(sample):
        quantiser = Quantiser(_matrix(sample["embedding"]))
        largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        chunks = _chunks(quantiser.bits, largest, radius)
        errors = radius // len(chunks)
        sent = spark.sparkContext.broadcast(quantiser)

        def code(batches):
            q = sent.value
            for batch in batches:
                x = _matrix(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(q.codes(x).view(np.int64) if len(x) else np.zeros(0, np.int64))], names=["cls", "space", "code"])

        def tables(batches):
            for batch in batches:
                cls, space, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
                for c, (shift, width) in enumerate(chunks):
                    value = (codes >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    masks = [sum(1 << b for b in some) for k in range(errors + 1) for some in combinations(range(width), k)]
                    for mask in masks:
                        there = value ^ np.uint64(mask)
                        ok = np.flatnonzero((there < value) | (mask == 0))
                        if len(ok):
                            yield pa.RecordBatch.from_arrays([pa.array(space[ok]), pa.array(np.full(len(ok), c, np.int32)), pa.array(there[ok].view(np.int64)), pa.array(np.full(len(ok), mask == 0)), pa.array(cls[ok]), pa.array(codes[ok].view(np.int64))], names=["space", "chunk", "value", "own", "cls", "code"])

        def meet(batches):
            for t, starts, ends in whole_runs(batches, ["key", "low", "high"]):
                block, low, high, chunk, own, cls, codes = (t[c].to_numpy() for c in ("block", "low", "high", "chunk", "own", "cls", "code"))
                codes = codes.view(np.uint64)
                for a, b in zip(starts, ends):
                    home, visit = np.flatnonzero(own[a:b]) + a, np.flatnonzero(~own[a:b]) + a
                    i, j = np.triu_indices(len(home), 1)
                    i, j = np.concatenate((home[i], np.repeat(home, len(visit)))), np.concatenate((home[j], np.tile(visit, len(home))))
                    if low[a] != high[a]:
                        ok = block[i] != block[j]
                        i, j = i[ok], j[ok]
                    differ = codes[i] ^ codes[j]
                    ok = np.bitwise_count(differ) <= radius
                    for shift, width in chunks[: chunk[a]]:  # a pair counts in the first chunk that it agrees in
                        ok &= np.bitwise_count((differ >> np.uint64(shift)) & np.uint64((1 << width) - 1)) > errors
                    if ok.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[i[ok]], cls[j[ok]])), pa.array(np.maximum(cls[i[ok]], cls[j[ok]]))], names=["a", "b"])

        def rerank(batches):
            for batch in batches:
                x, y = _matrix(batch.column(2)), _matrix(batch.column(3))
                ok = pa.array((x * y).sum(1) >= least if len(x) else np.zeros(0, bool))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(ok)

        coded = saved(classes.select("cls", F.xxhash64("label", F.size("embedding")).alias("space"), "embedding").mapInArrow(code, "cls long, space long, code long"), "codes")
        indexed = coded.mapInArrow(tables, "space long, chunk int, value long, own boolean, cls long, code long").withColumn("key", F.xxhash64("space", "chunk", "value"))
        order = ["key", "low", "high"]
        met = in_blocks(indexed.select("key", "chunk", "own", "cls", "code"), "key", BLOCK, "cls").repartition(*order).sortWithinPartitions(*order).mapInArrow(meet, "a long, b long")
        vector = by_shuffle(classes.select(F.col("cls").alias("c"), F.col("embedding").cast("array<double>").alias("v")))
        near = met.join(vector.withColumnsRenamed({"c": "a", "v": "va"}), "a").join(vector.withColumnsRenamed({"c": "b", "v": "vb"}), "b").select("a", "b", "va", "vb")
        links = saved(near.mapInArrow(rerank, "a long, b long"), "links")
    else:
        links = spark.createDataFrame([], "a long, b long")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(by_shuffle(classes.select(F.col("cls").alias("b"), "n")), "b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "cls")
    roots = by_shuffle(components(links).withColumnRenamed("node", "cls"))
    known = classes.select("cls", "n", "least_id").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least_id = known.groupBy("root").agg(F.min("least_id").alias("component"))
    known = known.join(least_id, "root").join(degree, "cls", "left").select(F.col("cls").alias("k"), "component", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = rows.select("vec_id", "cls").join(known, F.col("cls") == F.col("k"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
