"""What several operators share: gapless ranks, bitmaps, blocks of hot keys, lean workers; tables, hot joins and components come from the library."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sawmill.plans.tables import HOT, by_shuffle, components, fewer, hot_join, saved, shared_dir

__all__ = ["HOT", "bits_of", "by_shuffle", "components", "fewer", "hot_join", "in_blocks", "is_empty", "lean", "ranked", "saved", "shared_dir", "small_batches", "whole_runs", "worked_out"]


#: Rows in an Arrow batch: texts are long, and a worker holds a batch whole.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def lean(f):
    """A function over batches whose worker gives memory back when a task ends, as workers outlive tasks."""

    def run(batches):
        import ctypes
        import gc

        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def worked_out(rows: DataFrame, **columns: str) -> DataFrame:
    """rows with these columns (SQL), behind a generator of one row, which the optimizer doesn't merge with what comes after.

    Merged, a column that a lambda uses once would be worked out again for each element.
    """
    return rows.select("*", F.inline(F.array(F.struct(*(F.expr(sql).alias(name) for name, sql in columns.items())))))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def ranked(df: DataFrame, group: str, rank: str) -> DataFrame:
    """df with a gapless 0-based number within each value of the integer column ``group``, in no set order.

    No group is gathered: every task numbers its own rows, and a table of one row per task and group gives
    where each task's numbers begin. ``group`` may have few values (shards, lengths) or null.
    """
    schema = StructType([*df.schema.fields, StructField("_task", LongType()), StructField("_at", LongType())])

    def number(batches):
        import numpy as np
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            g = batch.column(batch.schema.get_field_index(group)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(g, kind="stable")
            keys, first, count = np.unique(g[order], return_index=True, return_counts=True)
            at = np.empty(len(g), np.int64)
            for k, i, c in zip(keys.tolist(), first.tolist(), count.tolist()):
                at[order[i : i + c]] = np.arange(c) + seen.get(k, 0)
                seen[k] = seen.get(k, 0) + c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(g), task, np.int64)), pa.array(at)], names=[*batch.schema.names, "_task", "_at"])

    done = saved(df.mapInArrow(number, schema), "ranked")
    # a task may have several files or splits: group by the number that it wrote, not by where a row is read from
    begin = done.groupBy("_task", group).agg(F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("_task").alias("_t"), F.col(group).alias("_g"), F.coalesce("_base", F.lit(0)).alias("_base"))
    return done.join(begin, (F.col("_task") == F.col("_t")) & F.col(group).eqNullSafe(F.col("_g"))).withColumn(rank, F.col("_at") + F.col("_base")).drop("_task", "_at", "_t", "_g", "_base")


def bits_of(ids: DataFrame, column: str, log2_bits: int = 23) -> bytes:
    """A bitmap of hashed ids: at most 2**log2_bits bits, whatever the number of ids (1 MiB at 23).

    As a prefilter before an exact join it never loses an id; with very many ids it lets more rows through.
    """
    import numpy as np

    h = F.pmod(F.xxhash64(column), F.lit(1 << log2_bits))
    rows = ids.select((h / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64({0}), 64) as int))".format(column)).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (log2_bits - 6), np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out.tobytes()


def whole_runs(batches, columns: list[str]):
    """From batches sorted by ``columns``: tables of whole runs of equal values there, with the runs' bounds (two arrays)."""
    import numpy as np

    def bounds(t):
        change = np.zeros(max(0, len(t) - 1), bool)
        for c in columns:
            v = t[c].to_numpy()
            change |= v[1:] != v[:-1]
        return np.flatnonzero(change) + 1

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        cut = bounds(t)
        if len(cut):
            yield t.slice(0, cut[-1]), np.concatenate(([0], cut[:-1])), cut
        rest = t.slice(cut[-1]) if len(cut) else t
    if rest is not None and len(rest):
        yield rest, np.zeros(1, np.int64), np.array([len(rest)])


def in_blocks(rows: DataFrame, key: str, block: int, salt: str) -> DataFrame:
    """rows of a key with many rows, dealt to pairs of blocks: any two rows of a key meet under one (key, low, high).

    Each key's rows fall into blocks of about ``block`` rows by a hash of the column ``salt``; a row of block i goes to
    every pair (low, high) that i is in. So no task takes a whole hot key, and keys of one row are dropped. Adds block, low, high.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key"), F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    rows = rows.join(by_shuffle(sizes), F.col(key) == F.col("_key")).withColumn("block", F.expr(f"cast(pmod(xxhash64({salt}, 3), _blocks) as int)"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).drop("_key", "_blocks", "_other")
