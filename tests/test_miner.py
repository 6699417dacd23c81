"""Sequential mining: traces derived by hand, line by line; the log of changes; restart of a stream from its checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from sawmill.functions.text import preprocess
from sawmill.operators import lcs
from sawmill.sources.presets import SHARED_MASKS
from sawmill.streaming import miner

A, B, G = (f"job {x} started on node seven" for x in ("alpha", "beta", "gamma"))
MERGED = "job <*> started on node seven"
DISK = ["disk check passed on node seven", "disk check not passed on node seven"]

#: (lines, templates with their lines after each prefix)
TRACES = {
    "no merge at a quarter": (
        ["Connection from 10.0.0.1 closed", "Connection from 10.0.0.2 closed", "Connection from 10.0.0.3 refused"],
        [{"Connection from <*> closed": 1}, {"Connection from <*> closed": 2}, {"Connection from <*> closed": 2, "Connection from <*> refused": 1}],
    ),
    "merge, split and merge again": ([A, B, A, B, G], [{A: 1}, {MERGED: 2}, {MERGED: 3}, {A: 2, B: 2}, {MERGED: 5}]),
    "reserved signs": (["value <*> seen in map {x}"], [{"value ＜*＞ seen in map ｛x｝": 1}]),
    "one word": (["12345", "12345"], [{"12345": 1}, {"12345": 2}]),
    "empty gap": (DISK * 2, [{DISK[0]: 1}, {"disk <*> passed on node seven": 2}, {"disk <*> passed on node seven": 3}, {"disk check{V} passed on node seven": 2, DISK[1]: 2}]),
}


def lines_of(spark, lines, dataset="d"):
    return preprocess(spark.createDataFrame([(dataset, i, t) for i, t in enumerate(lines)], "dataset string, line_no long, content string"), "content", [], SHARED_MASKS)


def state_of(lines, log):
    """{template: lines} by the log alone, and what must hold of it."""
    names = {(r.dataset, r.template_id): r.template_text for r in miner.templates_now(log).collect()}
    of = {(r.dataset, r.sample_id): (r.dataset, r.template_id) for r in miner.samples_now(log).collect()}
    assert len(set(names.values())) == len(names) and set(of.values()) == set(names)
    out: dict = {}
    for r in lines.select("dataset", F.xxhash64("dataset", "content").alias("s")).collect():
        text = names[of[r.dataset, r.s]]
        out[text] = out.get(text, 0) + 1
    return out


@pytest.mark.parametrize("name", TRACES)
def test_traces_by_prefix(spark, name):
    """Each prefix of a trace is a dataset of its own, so all of them are mined in one go."""
    lines, want = TRACES[name]
    every = None
    for n in range(1, len(lines) + 1):
        part = lines_of(spark, lines[:n], f"{n}")
        every = part if every is None else every.union(part)
    log = miner.mine_online(every).cache()
    for n in range(1, len(lines) + 1):
        assert state_of(every.where(F.col("dataset") == f"{n}"), log.where(F.col("dataset") == f"{n}")) == want[n - 1]


def test_limits(spark):
    """A template's limit is 2 at first, twice its lines once a split was tried, and the least of those that are merged."""
    lines = lines_of(spark, [A, B, A, B, G])
    log = miner.mine_online(lines).where("kind = 'template'").orderBy("at").collect()
    assert [(r.line_no, r.reason, r.template_text, r.sample_limit) for r in log] == [
        (0, "new", A, 2), (1, "merged", MERGED, 2), (1, "limit", MERGED, 4), (3, "split", A, 4), (3, "split", B, 4), (4, "merged", MERGED, 2), (4, "limit", MERGED, 10),
    ]


def test_options(spark):
    lines = lines_of(spark, [A, B, A, B, "12"])
    assert state_of(lines, miner.mine_online(lines, merge=False)) == {A: 2, B: 2, "12": 1}
    assert state_of(lines, miner.mine_online(lines, split=False)) == {MERGED: 4, "12": 1}
    assert miner.mine_online(lines.where("false")).count() == 0
    nothing = lines.withColumn("content", F.lit(None).cast("string"))
    assert miner.mine_online(nothing).count() == 0


def test_relabelled_lines(spark):
    """What a second half of the lines does to the events of the first is read from the log alone."""
    log = miner.mine_online(lines_of(spark, [A, B, A, B, G])).cache()
    first, both = (miner.samples_now(x) for x in (log.where("line_no <= 1"), log))
    before, after = ({r.sample_id: r.template_id for r in x.collect()} for x in (first, both))
    moved = {r.sample_id: (r.from_id, r.template_id) for r in miner.relabelled(log, since=1).collect()}
    assert moved == {s: (before.get(s), t) for s, t in after.items() if before.get(s) != t} and len(moved) == 3
    assert not miner.relabelled(log, since=4).collect()


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Files one after the other, the query stopped and started again between them: the log is that of the whole table, whatever the batches."""
    rng = random.Random(4)
    lines = [f"{rng.choice(['open', 'close'])} file number {rng.choice('abcdefg')} by user {rng.choice(['ann', 'bob'])} now" for _ in range(60)] + DISK * 3
    whole = lines_of(spark, lines)
    want = [tuple(r) for r in miner.mine_online(whole).orderBy("at").collect()]
    schema = "dataset string, line_no long, content string"
    for k, cut in enumerate([0, 7, 8, 40]):
        end = [7, 8, 40, len(lines)][k]
        whole.where(F.col("line_no").between(cut, end - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        log = miner.mine_online(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        query = log.writeStream.format("parquet").option("path", f"{tmp_path}/log").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/log").orderBy("at").collect()]
    assert got == want
    assert state_of(whole, spark.read.parquet(f"{tmp_path}/log")) == state_of(whole, miner.mine_online(whole))


def test_clusters_go_by_rows_of_distances():
    """Two texts are one at a distance of 0.3 / sqrt 2 at most; with more of them, rows differ in the distances to the others too."""
    a, b = "a b c d e f g h", "a b c d e f g x"
    assert miner.cluster_of_last([a, b]) == [0, 1]  # 1/8 * sqrt 2
    assert miner.cluster_of_last(["a b c d", "a b c x"]) == [1]  # 1/4 * sqrt 2 is more than 0.3
    assert miner.cluster_of_last([a, "q r s t u v w", b]) == [0, 2]


def test_plan_has_one_shuffle(spark):
    plan = miner.mine_online(lines_of(spark, [A]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "line_no" in plan.split("Sort [")[1].split("]")[0]


def test_a_split_folds_texts_of_one_shape_once(monkeypatch):
    """Texts that differ in gaps only are folded and searched for gaps once; the runs and gaps are those of folding all (before: a fold for each text)."""
    texts = [f"user {i} of group {i % 3} {'read' if i % 2 else 'wrote'} page <*>" for i in range(400)]
    tokens = [lcs.tokenize(t) for t in texts]
    plain = [tokens[0]]
    for t in tokens[1:]:
        plain = lcs.fold(plain, [t], weighted=True)
    calls, fold = [], lcs.fold
    monkeypatch.setattr(lcs, "fold", lambda *a, **k: calls.append(1) or fold(*a, **k))
    assert lcs.fold_all(tokens, weighted=True) == plain
    assert len(calls) < 30
    for t in tokens:
        assert ["".join(t[a:b]) for a, b in lcs.gap_places(t, plain)] == lcs.gaps(t, plain)
    calls.clear()
    found = miner.branches(texts, 2)
    assert sorted(len(p) for _, p in found) == [200, 200] and len(calls) < 30


def test_fold_all_equals_folding_one_by_one():
    chance = random.Random(3)
    for weighted in (False, True):
        for _ in range(60):
            tokens = [[chance.choice("ab c.1") for _ in range(chance.randrange(1, 12))] for _ in range(40)]
            plain = [tokens[0]]
            for t in tokens[1:]:
                plain = lcs.fold(plain, [t], weighted=weighted)
            assert lcs.fold_all(tokens, weighted) == plain


def mined_in_parts(parts, **options):
    """What leaves the miner for a finished table of one key: lines come in these parts, as (line_no, content, later)."""
    import pandas as pd

    one = miner.Miner(keep=False, **options)
    one.handles = {"counters": type("Nothing", (), {"exists": lambda self: False})()}
    tables = (pd.DataFrame([(i, hash(t), t, later) for i, t, later in part], columns=["line_no", "sample_id", "content", "later"]) for part in parts)
    yield from one.handleInputRows(("d",), tables, None)


def test_samples_of_a_finished_table_are_on_disk(monkeypatch):
    """Three times the lines of one template take no more memory, and the log leaves in parts within a split too (before: all samples were held, and all changes of a split)."""
    import tracemalloc
    from itertools import batched

    monkeypatch.setattr(miner, "HELD", 200, raising=False)
    monkeypatch.setattr(miner, "LOGGED", 200)

    def peak(n):
        lines = ((k, f"order {k} of customer {k % 997} is {'open' if k < n - n // 4 else 'done'} now <*>", False) for k in range(n))
        tracemalloc.start()
        sizes = [len(part) for part in mined_in_parts(batched(lines, 500))]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, max(sizes)

    peak(3000)  # what is kept for all keys
    (small, a), (large, b) = peak(3000), peak(9000)
    assert large < small + 1_000_000 and a <= 210 and b <= 210, (small, large, a, b)


def test_the_log_does_not_depend_on_what_is_held(monkeypatch):
    """Rows on disk or in memory, batches cut within equal line numbers, and wildcards in gaps: the log is the same (before: such a cut was an error)."""
    chance = random.Random(5)
    parts = ["<*>", "1", "12", "<*> 1", "ab", "open", "close"]
    lines = [(k // 2, f"{chance.choice(parts)} - job {chance.choice(parts)} by {chance.choice(parts)}") for k in range(300)]
    lines = sorted(lines) + [(200 + k, f"order {k % 40} of customer {k} is {chance.choice(['open', 'done'])} now") for k in range(300)]
    last = {t: k for k, (_, t) in enumerate(lines)}
    lines = [(i, t, last[t] > k) for k, (i, t) in enumerate(lines)]
    log = lambda size: [r for part in mined_in_parts(lines[k : k + size] for k in range(0, len(lines), size)) for r in part.drop(columns="key0").astype(str).values.tolist()]
    want = log(1000)
    assert {"split", "absorbed", "merged", "limit"} <= {r[-1] for r in want}
    monkeypatch.setattr(miner, "HELD", 3)
    monkeypatch.setattr(miner, "LOGGED", 2)
    monkeypatch.setattr(miner, "SHAPES", 2)
    assert log(7) == want


def test_branches_where_a_late_wildcard_takes_values_in():
    """More values than branches may be, which one with a wildcard takes in at the end: as if all had been held."""
    tail = "files are read by ann"
    texts = [f"in:{k} {tail}" for k in range(30)] + [f"b {tail}"] + [f"in:{k} {tail}" for k in range(30, 60)]
    assert len(miner.branches(texts, 3)) == 1
    found = miner.branches([*texts, f"in:<*> {tail}"], 3)
    assert {name: sorted(places) for name, places in found} == {f"b {tail}": [30], f"in:<*> {tail}": [k for k in range(62) if k != 30]}
