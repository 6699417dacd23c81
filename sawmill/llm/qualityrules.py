"""Quality rules: a decision list learned from labelled statistics by sequential covering, as ordered Spark conditionals.

1. Statistics of whole texts: counts of words, characters, signs, lines and repeats (``statistics``), in one pass of vectorised tasks.
2. Labelled rows, at most SAMPLE of them and none that is held out, are cut in two parts by a hash: one grows rules, the other prunes them.
3. Sequential covering: a rule for the rarer label starts with no condition and takes, one after the other, the threshold on a feature with the greatest gain of
   information (FOIL), until it covers no other label or has MOST conditions. Its last conditions go again where the pruning part is better off without.
   A rule of at least PRECISION on both parts together joins the list, what it covers goes, and the next one is grown; the first that falls short ends the list.
4. The list is a chain of F.when over the statistics (``DecisionList.verdict``), which stays in the JVM and can be read (``DecisionList.text``).

The rows that the fixed rules drop (``base_failed``) never reach the list. Precision stands before recall, so that good documents stay.

Defined cases: null and empty texts have no words, all statistics 0, and fail the fixed rules; a null doc_id or label is never learned from; several labels of one
doc_id count as the lowest, several texts as the smallest; without labelled rows of both labels the list is empty and keeps all; ties of gain go to the first feature and the lowest threshold;
repeated rows give repeated results; an empty table gives no rows; columns of any name are carried through by ``good_by_rules``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.llm import textbytes as tb
from sawmill.llm.common import lean, small_batches

#: Labelled rows that are learned from, at most.
SAMPLE = 20_000
#: Conditions of a rule, rules of a list, and the share of the rows covered by a rule that must be of its label.
MOST, RULES, PRECISION = 4, 16, 0.95
#: Base rules: fewer words than this fail, and so do texts where more than this percentage of the words is repeated.
FEWEST_WORDS, MOST_REPEATED = 50, 50
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_uppers", "n_digits", "n_signs"]

_SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_UPPERS = np.isin(np.arange(256), np.arange(65, 91))
_DIGITS = np.isin(np.arange(256), np.arange(48, 58))
_SIGNS = tb.NOT_SPACE & ~tb.ALNUM
_LEADING = (np.arange(256) & 0xC0) != 0x80
_NEWLINE = np.arange(256) == 10


def _features() -> dict[str, Column]:
    """What rules are about, as expressions over STATISTICS; a share of nothing is 0."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return {
        "words": F.col("n_words").cast("double"), "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"),
        "distinct": share("n_distinct", "n_words"), "uppers": share("n_uppers", "word_chars"), "digits": share("n_digits", "word_chars"), "signs": share("n_signs", "n_words"), "line_words": share("n_words", "n_lines"),
    }


def _numbers(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 that are equal only for equal pairs, and how many there are; both sides are non-negative."""
    codes, found = pd.factorize(groups * (int(values.max()) + 1 if len(values) else 1) + values)
    return codes, len(found)


def text_statistics(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATISTICS of each text of a buffer; words and lines are told apart by their bytes, not by hashes."""
    inside = tb.NOT_SPACE[raw]
    starts, ends, first = tb.word_spans(raw, offsets, tb.NOT_SPACE)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    ids, _ = tb.exact_ids(raw, inside, ends - starts)
    of, _ = _numbers(row, ids)
    distinct = np.bincount(row[np.unique(of, return_index=True)[1]], minlength=len(n))
    # words in windows of three that are found twice in the text; a window lies in one text
    begin = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    two, _ = _numbers(of[begin], ids[begin + 1])
    three, found = _numbers(two, ids[begin + 2])
    again = begin[np.bincount(three, minlength=found)[three] > 1] if len(begin) else begin
    repeated = np.zeros(len(row), bool)
    for k in range(3):
        repeated[again + k] = True
    # lines: each row has one more than line ends
    breaks = np.flatnonzero(raw == 10)
    line_starts, line_ends = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable"), np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
    line_row = np.repeat(np.arange(len(n)), tb.counts_in(_NEWLINE[raw], offsets) + 1)
    line_ids, _ = tb.exact_ids(raw, raw != 10, line_ends - line_starts)
    worded = _any_in(inside, line_starts, line_ends)
    line_row, line_ids = line_row[worded], line_ids[worded]
    lines = np.bincount(line_row, minlength=len(n))
    pair, _ = _numbers(line_row, line_ids)
    different = np.bincount(line_row[np.unique(pair, return_index=True)[1]], minlength=len(n))
    count = lambda table: tb.counts_in(table[raw], offsets)
    return {
        "n_words": n, "word_chars": tb.counts_in(inside & _LEADING[raw], offsets), "n_symbols": count(_SYMBOLS), "n_dup_lines": lines - different, "n_repeat_words": tb.counts_in(repeated, first),
        "n_lines": lines, "n_distinct": distinct, "n_uppers": count(_UPPERS), "n_digits": count(_DIGITS), "n_signs": count(_SIGNS),
    }


def _any_in(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[ends] > sums[starts]


def statistics(documents: DataFrame) -> DataFrame:
    """(row, STATISTICS) of each row of documents(text, ...); row: the row as a struct."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))

    @lean
    def count(batches):
        for batch in batches:
            raw, offsets = tb.text_buffer(batch.column(1))
            for i, j in tb.slices(offsets):
                found = text_statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(found[c].astype(np.int64)) for c in STATISTICS)], names=["row", *STATISTICS])

    return rows.mapInArrow(count, f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in STATISTICS))


def base_failed() -> Column:
    """The fixed rules, over STATISTICS."""
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = _features()[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in their order: a row that all conditions of a rule hold for, and of none before it, has the label of the rules; the others have the other one."""

    rules: tuple[tuple[Condition, ...], ...] = ()
    label: int = 0

    def rule(self) -> Column:
        """The number of the rule that decides, from 1; null for none."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            every = F.lit(True)
            for c in self.rules[k - 1]:
                every = every & c.column()
            out = F.when(every, k).otherwise(out)
        return out

    def verdict(self) -> Column:
        """The label that the list gives, as an int."""
        return F.when(self.rule().isNotNull(), self.label).otherwise(1 - self.label) if self.rules else F.lit(1)

    def text(self) -> str:
        lines = [f"{'if' if not k else 'else if'} {' and '.join(map(str, rule))}: {self.label}" for k, rule in enumerate(self.rules)]
        return "\n".join([*lines, f"else: {1 - self.label if self.rules else 1}"])


def _best_condition(x: pd.DataFrame, y: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the greatest gain p * (log2(p / (p + n)) - log2(P / (P + N))), over all midpoints between values."""
    whole, best = np.log2(y.mean()), (1e-9, None)
    for feature in x.columns:
        v = x[feature].to_numpy()
        order = np.argsort(v, kind="stable")
        s = v[order]
        cut = np.flatnonzero(s[1:] > s[:-1])
        if not len(cut):
            continue
        p = np.cumsum(y[order])[cut]
        n = cut + 1 - p
        middle = (s[cut] + s[cut + 1]) / 2
        for above in (False, True):
            a, b = (y.sum() - p, len(y) - y.sum() - n) if above else (p, n)
            gain = np.where(a > 0, a * (np.log2(np.maximum(a, 1) / np.maximum(a + b, 1)) - whole), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = float(gain[k]), Condition(feature, above, float(middle[k]))
    return best


def _covered(rule: list[Condition], x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grown(x: pd.DataFrame, y: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < MOST and 0 < y.sum() < len(y):
        _, condition = _best_condition(x, y)
        if condition is None:
            break
        rule.append(condition)
        held = condition.holds(x)
        x, y = x[held], y[held]
    return rule


def _pruned(rule: list[Condition], x: pd.DataFrame, y: np.ndarray) -> list[Condition]:
    """The beginning of the rule of the greatest (p - n) / (p + n) on these rows; of equals the shortest."""

    def worth(k: int) -> float:
        held = _covered(rule[:k], x)
        return (2 * y[held].sum() - held.sum()) / held.sum() if held.any() else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learned(x: pd.DataFrame, y: np.ndarray, prunes: np.ndarray) -> DecisionList:
    """A list from rows of features with labels of 0 or 1, of which ``prunes`` tells which prune."""
    if not len(y) or y.min() == y.max():
        return DecisionList()
    label = int(2 * y.sum() < len(y))  # the rarer one; 0 of equals
    left, mine, rules = np.ones(len(y), bool), y == label, []
    while len(rules) < RULES and (mine & left & ~prunes).any():
        grow, prune = left & ~prunes, left & prunes
        rule = _pruned(_grown(x[grow], mine[grow]), x[prune], mine[prune])
        held = left & _covered(rule, x)
        if not rule or not held.any() or mine[held].mean() < PRECISION:
            break
        rules.append(tuple(rule))
        left &= ~held
    return DecisionList(tuple(rules), label)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def decision_list(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """The list learned from labels(doc_id, quality) of rows that aren't held out, at most ``sample`` of them, chosen by a hash of the doc_id."""
    spark = documents.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    small = F.broadcast(spark.createDataFrame(pa.Table.from_pandas(chosen.astype("int64"), preserve_index=False)))  # at most ``sample`` rows
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(small, "doc_id")
    rows = statistics(texts).select("row.doc_id", "row.quality", *(c.alias(k) for k, c in _features().items()), F.xxhash64("row.text").alias("_text"))
    train = rows.toPandas().sort_values(["doc_id", "_text"]).drop_duplicates("doc_id").reset_index(drop=True)
    x = train[list(_features())].astype(float)
    return learned(x, train["quality"].to_numpy().astype(np.int64), train["doc_id"].map(lambda d: hash_of(int(d)) % 3 == 0).to_numpy(bool))


def hash_of(n: int) -> int:
    """A fixed scramble of a number."""
    return int(tb.mix(np.array([n], np.int64).view(np.uint64))[0] >> np.uint64(20))


def _judged(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    rules = decision_list(documents, labels, sample)
    rows = statistics(documents).withColumns({"base_failed": base_failed(), "rule": rules.rule()})
    return rows.withColumn("kept", ~F.col("base_failed") & (rules.verdict() == 1))


def quality_rules(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, STATISTICS, base_failed, kept, rule) of each row of documents; rule: the number of the rule that decides, null for none."""
    return _judged(documents, labels, sample).select(F.col("row.doc_id").cast("long").alias("doc_id"), *STATISTICS, "base_failed", "kept", "rule")


def good_by_rules(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """documents without the rows that fail the fixed rules or that the list rejects; rows and columns as they came."""
    return _judged(documents, labels, sample).where("kept").select("row.*")
