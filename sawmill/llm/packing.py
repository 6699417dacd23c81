"""Best-fit packing of token sequences by exact-complement hashing.

Tokenising is a pass of tasks over their own rows, a window of about ``SLICE`` bytes at a time; token ids of units
(runs that the tokenizer's own splitting never joins) are kept in a bounded cache in each worker. How pieces are
combined depends on the number of pieces of each length alone, and there are at most ``CAPACITY`` lengths: the plan is made from
that histogram and says, for each length, which ranks of its pieces go to which sequences. Ranks come from counts by task, so no
length is ever gathered.

Defined cases: null text is empty (one piece, the id 0); a null doc_id is carried through; repeated rows are packed
each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sawmill.llm import textbytes as tb
from sawmill.llm.common import lean, ranked, small_batches

CAPACITY = 2048
END = 0
SLICE = 1 << 18
#: Units whose ids a worker keeps; a full cache starts anew.
CACHE = 150_000

_KIND = np.full(256, 3, np.int8)  # 3: apostrophe, control and non-ASCII bytes, never cut off from their neighbours
_KIND[[i for i in range(33, 127) if chr(i) != "'"]] = 2
_KIND[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_LETTERS = re.compile(r"[a-zà-öø-ÿ]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Units:
    """Token ids of units by the hash of the unit: exact, as no token of this kind of tokenizer crosses units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread would hold memory of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these stand for themselves
        rest = iter(range(256, 512))
        self.alphabet = {i: chr(i) if i in shown else chr(next(rest)) for i in range(256)}
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, units: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(units)
        slow, model, alphabet = [], self.tokenizer.model, self.alphabet
        for k, u in enumerate(units):
            t = u.decode().lower()
            if len(t) < 200 and _LETTERS.fullmatch(t):  # composed letters only: what the normaliser does is lower case
                out[k] = [x.id for x in model.tokenize(t if t.isascii() else "".join(alphabet[b] for b in t.encode()))]
            else:
                slow.append(k)
        for k, e in zip(slow, self.tokenizer.encode_batch([units[k].decode() for k in slow], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        """hashes: sorted, none known."""
        ids = self.encode(units)
        size = np.array([len(i) for i in ids], np.int64)
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate((self.flat, np.array([x for i in ids for x in i], np.int32)))
        every = np.concatenate((self.hashes, hashes))
        order = np.argsort(every, kind="stable")
        self.hashes, self.at, self.size = every[order], np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]

    def tokens(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows joined, each closed by END, and where each row's begin."""
        special = b"<|" in raw.tobytes()  # may be a special token: then white space alone parts units, and case counts
        kind = _KIND[raw]
        inside = kind > 0
        first, last = inside.copy(), inside.copy()
        if len(raw):
            parted = ~inside[:-1] | ~inside[1:]
            if not special:
                parted |= (kind[:-1] + kind[1:] == 3) & (kind[:-1] > 0) & (kind[1:] > 0)
            first[1:] &= parted
            last[:-1] &= parted
            rows = offsets[:-1] < offsets[1:]
            heads, tails = offsets[:-1][rows], offsets[1:][rows] - 1
            first[heads], last[tails] = inside[heads], inside[tails]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes, where, inverse = np.unique(tb.word_hashes(raw, starts, ends, lower=not special), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE:
            self.clear()
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        if not known.all():
            data, new = raw.tobytes(), np.flatnonzero(~known)
            self.learn(hashes[new], [data[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
            at = np.searchsorted(self.hashes, hashes)
        size, begin = self.size[at][inverse], self.at[at][inverse]
        units_before = np.searchsorted(starts, offsets)
        total = np.concatenate(([0], np.cumsum(size)))
        rows_at = total[units_before] + np.arange(len(offsets))
        out = np.full(rows_at[-1], END, np.int32)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(units_before))
        target = np.repeat(row, size) + np.arange(total[-1])
        out[target] = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return out, rows_at


_units: dict[str, Units] = {}


def pieces(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the token sequences, cut where longer than ``capacity``."""
    path = tokenizer or default_tokenizer()
    small_batches(documents.sparkSession)

    @lean
    def cut(batches):
        units = _units[path] = _units.get(path) or Units(path)
        for batch in batches:
            raw, offsets = tb.text_buffer(batch.column(1))
            for i, j in tb.slices(offsets, SLICE):
                ids, at = units.tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                count = np.diff(at)
                n = (count + capacity - 1) // capacity
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, count[doc] - start)
                data, begin = memoryview(ids.astype("<u4").tobytes()), (at[doc] + start) * 4
                crc = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + length * 4).tolist())]
                columns = [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin // 4, len(ids)), pa.int32()), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def _exact(count: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that fill the gap exactly, the largest first."""
    if gap < len(count) and count[gap]:
        return [gap]
    have = count > 0

    def pair(total: int, most: int) -> list[int] | None:
        b = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
        b = b[b < len(count)]
        ok = have[b] & have[total - b] & ((b * 2 != total) | (count[b] >= 2))
        return [int(b[ok.argmax()]), int(total - b[ok.argmax()])] if ok.any() else None

    if gap >= 2 and (two := pair(gap, gap - 1)):
        return two
    for a in np.flatnonzero(have[: max(0, gap - 1)])[::-1].tolist():
        if a * 3 < gap:
            break
        count[a] -= 1
        have[a] = count[a] > 0
        two = pair(gap - a, a)
        count[a] += 1
        have[a] = True
        if two:
            return [a, *two]
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """((length, first rank, ranks, first sequence, offset) rows, number of sequences).

    The largest length left opens a sequence. Its gap is filled by an exact complement of one, two or three lengths
    if there is one; else the largest length that fits goes in and the rest of the gap is tried again. The same
    combination is used as often as its lengths allow, so each step uses up a length: there are at most ``capacity`` steps.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    used, rows, sequences = np.zeros(capacity + 1, np.int64), [], 0
    while count.any():
        chosen = [int(np.flatnonzero(count)[-1])]
        left = count.copy()
        left[chosen[0]] -= 1
        gap = capacity - chosen[0]
        while gap:
            more = _exact(left, gap)
            if more is None:
                fits = np.flatnonzero(left[: gap + 1])
                if not len(fits):
                    break
                more = [int(fits[-1])]
            for m in more:
                left[m] -= 1
            chosen += more
            gap -= sum(more)
        lengths, times = np.unique(chosen, return_counts=True)
        n = int((count[lengths] // times).min())
        offset = 0
        for m in chosen:
            rows.append((m, int(used[m]), n, sequences, offset))
            used[m] += n
            count[m] -= n
            offset += m
        sequences += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequences


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset added; cut: what ``pieces`` gives, or any rows with a length of 1 to ``capacity``."""
    rows = ranked(cut, "length", "_rank")
    table, _ = plan({r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    sent = cut.sparkSession.sparkContext.broadcast(table)
    wide = 1 << 48

    def place(batches):
        t = sent.value
        keys = t[:, 0] * wide + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            keep = [i for i, c in enumerate(batch.schema.names) if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(t[at, 3] + rank - t[at, 1]), pa.array(t[at, 4])], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    return rows.mapInArrow(place, StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def best_fit_packing(documents: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece of documents(doc_id, text, ...)."""
    return packed(pieces(documents, tokenizer, with_ids=with_ids))
