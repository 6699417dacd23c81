"""Joins with hot keys, the shared folder, and the entry without its optional parts."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sawmill.plans import tables

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("hot", [2, 50, 4096])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_joins_equal_joins(spark, monkeypatch, hot, how):
    """With a key of a third of all rows, keys that the table lacks, and null keys."""
    monkeypatch.setattr(tables, "HOT", hot)
    monkeypatch.setattr(tables, "LEAST_HOT", 10_000 if hot == 4096 else 0)
    rows = spark.createDataFrame([(k, 1 if k % 3 == 0 else None if k % 50 == 1 else k % 17, str(k)) for k in range(300)], "id long, key long, value string")
    table = rows.where("key is not null and key <> 5").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = tables.hot_join(rows, table, "key", how=how)
    want = rows.join(table, "key", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_joins_on_two_keys(spark):
    rows = spark.createDataFrame([(k % 2, k % 3, k) for k in range(60)], "a long, b long, id long")
    table = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, tables.hot_join(rows, table, ["a", "b"]).select("id", "n").collect())) == [(k, 10) for k in range(60)]


def test_a_cluster_needs_a_shared_folder():
    conf = {"spark.master": "spark://somewhere:7077"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__))
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(session)
    conf["spark.checkpoint.dir"] = "hdfs://shared/x/"
    assert tables.shared_dir(session) == "hdfs://shared/x"


@pytest.mark.parametrize(("gone", "left"), [((), "op1_ pipeline preprocess"), (("corpus_pipeline",), "op1_ preprocess"), (("corpus_pipeline", "sawmill.llm"), "preprocess")])
def test_entry_without_optional_parts(gone, left):
    """Modules that are absent, by a finder that doesn't find them; other errors of an import are raised."""
    if (ROOT / "sawmill" / "llm").is_dir() and (ROOT / "corpus_pipeline.py").exists():
        code = f"""
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in {gone!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Absent())
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
names = set(e.queries())
print(*sorted({{n[:4] if n.startswith("op1_") else n for n in names if n.startswith("op1_") or n in ("pipeline", "preprocess")}}))
assert set(e.oracle_sql()) <= names
"""
        done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
        assert done.stdout.strip() == left, done.stderr


def test_small_graphs_take_few_tasks(spark, tmp_path, monkeypatch):
    """With many shuffle partitions and none of them joined, a graph of few edges is still written by few tasks in each round (before: by one for each partition)."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    monkeypatch.setattr(tables, "shared_dir", lambda spark: f"file://{tmp_path}")
    for k, v in zip(before, ("97", "false")):
        spark.conf.set(k, v)
    try:
        edges = spark.range(500).selectExpr("id as a", "if(id % 50 = 0, id, id - 1) as b")
        roots = {r.node: r.root for r in tables.components(edges, 500).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert roots == {i: i - i % 50 for i in range(500)}
    most = 2 * spark.sparkContext.defaultParallelism
    written = [len(list(p.glob("part-*"))) for p in tmp_path.glob("sawmill-edges-*")]
    assert len(written) > 2 and max(written) <= most
