"""Tables that cut lineage, joins whose keys may be hot, and connected components of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where unset, a new one on one machine (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str = "part") -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/sawmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task takes at least, where there are fewer tasks than the session's partitions.
FEW = 250_000


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """df, of some ``rows`` rows, in fewer partitions than a shuffle has, where these would be nearly empty: two for each core, or one for FEW rows if that is more.

    Adaptive execution joins small partitions too, where it may; tables that are shuffled again and again cost as many tasks each time.
    """
    n = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FEW))
    return df.coalesce(n) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def by_shuffle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, which has ``rows`` rows (or no known bound), for a join in which it isn't broadcast, unless it has at most FEW.

    Before a query runs, Spark goes by the size of files, and ids that come again and again, or rows that a task makes, take far more in memory: such a table would pass through the driver.
    """
    return df.hint("merge") if rows is None or rows > FEW else df


#: Keys that hold more than this share (1 / HOT) of all rows, and more than LEAST_HOT of them, are hot; there are fewer than HOT such keys.
HOT, LEAST_HOT = 4096, 10_000


def hot_join(rows: DataFrame, table: DataFrame, key: str | list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row for each key and how many rows there are of it in column ``n``.

    Hot keys, of which there are fewer than HOT, are joined by broadcast, so that their rows stay where they are; all others meet by a shuffle, where none
    has more than a small share of the rows. Without hot keys it is a plain join. ``how``: inner or left. Both tables may be read twice.
    """
    key = [key] if isinstance(key, str) else key
    total, most = (x or 0 for x in table.agg(F.sum(n), F.max(n)).first())
    limit = max(total // HOT, LEAST_HOT)
    if most <= limit:
        return rows.join(table, key, how)
    hot = F.broadcast(table.where(F.col(n) > limit))  # fewer than HOT rows
    rest = rows.join(hot.select(*key), key, "left_anti").join(table.where(F.col(n) <= limit), key, how)
    return rows.join(hot, key).unionByName(rest)


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Connected components of the undirected graph with edges (a, b).

    Alternating large-star and small-star rounds over the edge table until nothing changes; every round is a
    grouped minimum and an equi-join; the minima may be broadcast where there are at most FEW edges, and beyond that a hub is split as any
    skewed key by adaptive execution. Returns (node, root),
    root being the smallest node of the component; nodes without edges are absent. Nulls and loops are dropped.
    rows: about how many edges there are, where that is known.
    """

    def least(sym: DataFrame) -> DataFrame:
        minima = by_shuffle(sym.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), "m"), before[0])
        return sym.join(minima, F.col("u") == F.col("mu")).select("u", "v", F.least("m", "u").alias("m"))

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 7))")).first())

    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = saved(now if rows is None else fewer(now, rows), "edges")
    before = mark(now)
    while before[0]:
        slim = lambda df: fewer(df, 2 * before[0])  # noqa: B023, E731
        large = slim(slim(least(both(now)).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")).distinct())
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = slim(least(down))
        now = saved(slim(small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    star = fewer(now.groupBy("a").agg(F.min("b").alias("root")), before[0])
    return star.select(F.col("a").alias("node"), "root").union(star.select(F.col("root").alias("node"), "root").distinct())
