"""Periodic runs of words by harmonic grid probing.

A run with period p is a stretch of words where words p apart are equal, of at least FEWEST_PERIODS * p words and LEAST words, that neither neighbour extends and that has no smaller
period. Its p-apart pairs begin at (FEWEST_PERIODS - 1) * p places in a row or more, so that many multiples of p are among them:

1. For each p the words at the multiples of p are compared with the next multiple, which costs 1 / p of the text and the harmonic sum of it for all p.
   FEWEST_PERIODS - 1 equal pairs in a row are a survivor.
2. A survivor is extended to both sides by comparing chunks of the word numbers with those p further on, chunks doubling up to CHUNK words.
3. Grid points within a found stretch are skipped: those of p itself, and those of a run whose period divides p and that holds both
   words of a pair, as its stretch of p is the run again (p words of it fix all others).

The texts of a batch are one array of exact word numbers (equal only for equal bytes), each followed by a number of its own, longest text first: a period only concerns the
texts that are long enough for it, which stand in front. Work is in proportion to n log n for a text of n words, besides the extensions, which end at the first
difference. Nothing is shuffled: each row is read once, by the task that holds it.

Defined cases: null and empty texts have no words and no runs, and the digests of the empty string; a null doc_id is never a planted case; repeated rows give repeated results; texts are never
cut, however long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.llm import textbytes as tb
from sawmill.llm.common import lean, small_batches

LEAST, FEWEST_PERIODS = 6, 4
#: Words compared at once, at most; the first chunk has FIRST_CHUNK.
FIRST_CHUNK, CHUNK = 32, 1 << 16


def _until_right(w: np.ndarray, i: int, p: int) -> int:
    """The first place from i on where w differs from p places on; the last number of w stands nowhere else."""
    size = FIRST_CHUNK
    while True:
        other = w[i + p : i + p + size]
        differ = w[i : i + len(other)] != other
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, size = i + len(other), min(2 * size, CHUNK)


def _until_left(w: np.ndarray, i: int, p: int) -> int:
    """The smallest place down to which, from i, w equals p places on."""
    size = FIRST_CHUNK
    while i:
        a = max(0, i - size)
        differ = (w[a:i] != w[a + p : i + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i, size = a, min(2 * size, CHUNK)
    return 0


def periodic_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text (an array of word numbers of 0 or more): its runs as (start, length, period), by start and then period."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    begin, parts, at = {}, [], 0
    for k in order:
        begin[k] = at
        parts += [texts[k], np.array([-1 - k], np.int64)]
        at += len(texts[k]) + 1
    w = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    sizes = [len(texts[k]) for k in order]
    holder = np.full(len(w), -1, np.int32)  # the run found last at each word
    runs: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    live, p = len(order), 0
    while True:
        p += 1
        least = max(LEAST, FEWEST_PERIODS * p)
        while live and sizes[live - 1] < least:
            live -= 1
        if not live:
            break
        grid = w[: begin[order[live - 1]] + sizes[live - 1] + 1 : p]
        equal = grid[1:] == grid[:-1]
        if len(equal) < FEWEST_PERIODS - 1:
            continue
        row = equal[FEWEST_PERIODS - 2 :].copy()
        for k in range(FEWEST_PERIODS - 2):
            row &= equal[k : k + len(row)]
        places = np.flatnonzero(row) * p
        k = 0
        while k < len(places):
            i = int(places[k])
            if (r := holder[i]) >= 0 and p % runs[r][2] == 0 and i + p < runs[r][1]:
                k = int(np.searchsorted(places, runs[r][1] - p))
                continue
            stop = _until_right(w, i, p)
            if stop > i + (FEWEST_PERIODS - 2) * p:
                start, end = _until_left(w, i, p), stop + p
                if end - start >= least and (start, end) not in seen:
                    seen.add((start, end))
                    holder[start:end] = len(runs)
                    runs.append((start, end, p))
            k = int(np.searchsorted(places, stop, "right"))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = np.array([begin[k] for k in order])
    for start, end, p in runs:
        k = order[int(np.searchsorted(starts, start, "right")) - 1]
        out[k].append((start - begin[k], end - start, p))
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, as an exact fraction; of equals the first, then the one of the smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """The word numbers of a text of n words, of which one in ten texts (by doc_id) repeats a stretch up to its end."""
    at = np.arange(n, dtype=np.int64)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + np.arange(n - a) % p
    return at


def _hex(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def periodic_texts(documents: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, collapsed) of each row of documents(doc_id, text, ...).

    start to exponent_milli are of the run with the most periods; runs: all, as structs; collapsed: the words that no run holds after its first period, joined by
    one space. With ``plant``, one text in ten gets a repeated end first (``planted``), so that there is something to find.
    """
    small_batches(documents.sparkSession)

    @lean
    def find(batches):
        for batch in batches:
            raw, offsets = tb.text_buffer(batch.column(1))
            for i, j in tb.slices(offsets):
                part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = tb.word_spans(part, at, tb.NOT_SPACE)
                ids, pieces = tb.exact_ids(part, tb.NOT_SPACE[part], ends - starts)
                docs = batch.column(0).slice(i, j - i)
                which = [(planted(d, int(n)) if plant else np.arange(n)) + a for d, n, a in zip(docs.to_pylist(), np.diff(first), first)]
                found = periodic_runs([ids[x] for x in which])
                kept = []
                for x, runs in zip(which, found):
                    keep = np.ones(len(x), bool)
                    for start, length, period in runs:
                        keep[start + period : start + length] = False
                    kept.append(x[keep])
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int64)
                texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), pieces.take(pa.array(np.concatenate(kept)))), pa.scalar(b" ", pa.large_binary())).to_pylist()
                best = [longest(runs) for runs in found]
                column = lambda f: pa.array([None if b is None else f(b) for b in best], pa.int64())
                listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
                lines = ["".join(f"{s},{n},{q}\n" for s, n, q in runs).encode() for runs in found]
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array([len(r) for r in found], pa.int64()), column(lambda b: b[0]), column(lambda b: b[1]), column(lambda b: b[2]), column(lambda b: 1000 * b[1] // b[2]), pa.array(map(_hex, lines)), pa.array(map(_hex, texts)), listed, pa.array([t.decode() for t in texts])],
                    names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"],
                )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbers = ", ".join(f"{c} long" for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli"))
    return docs.mapInArrow(find, f"{numbers}, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string")
