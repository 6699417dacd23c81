import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sawmill.functions.text import preprocess
from sawmill.operators import lcs, match, mining
from sawmill.operators.extract import answered, extract, matcher
from sawmill.sources.presets import SHARED_MASKS


def mined(spark, lines, masks=SHARED_MASKS, **options):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "dataset string, line_no long, content string")
    found, names = mining.mine(preprocess(df, "content", [], masks), **options)
    assert found.agg(F.sum("log_num")).first()[0] == len(lines)
    sizes = found.groupBy("template_id").agg(F.sum("log_num").alias("n"))
    return {r.template_text: r.n for r in names.join(sizes, "template_id").collect()}


A, B = "job alpha started on node seven", "job beta started on node seven"


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["Connection from 10.0.0.1 closed", "Connection from 10.0.0.2 closed", "Connection from 10.0.0.3 refused"], {"Connection from <*> closed": 2, "Connection from <*> refused": 1}),
        ([A, B, A, B], {A: 2, B: 2}),
        ([A, B, A, B, "job gamma started on node seven"], {"job <*> started on node seven": 5}),
        (["12345", "12345"], {"12345": 2}),
        (["disk check passed on node seven", "disk check not passed on node seven"] * 2, {"disk check{V} passed on node seven": 2, "disk check not passed on node seven": 2}),
        (["value <*> seen in map {x}"], {"value ＜*＞ seen in map ｛x｝": 1}),
    ],
)
def test_traces(spark, lines, want):
    assert mined(spark, lines) == want


def test_covered_templates_are_absorbed(spark):
    lines = ["start of the long job alpha now here", "start of the long job beta now here", "start of the long job gamma now here", "start of the long job one two three four five six seven now here"]
    wide = "start of the long job <*> now here"
    assert mined(spark, lines) == {wide: 4}
    assert mined(spark, lines, contained=True) == {wide: 3, lines[3]: 1}


def test_identity(spark):
    assert mined(spark, [A, B, A], merge=False, split=False) == {A: 2, B: 1}


def test_distance_pairs_lose_nothing(spark):
    from itertools import combinations

    texts = [f"the {x} went {y} the {z} at noon" for x in ("cat", "dog", "fox") for y in ("over", "under") for z in ("hill", "lake road")] + ["other words here", "x", "..."]
    df = mining.samples(spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "dataset string, line_no long, content string"))
    ids = {r.sample_text: r.sample_id for r in df.collect()}
    want = {tuple(sorted((ids[a], ids[b]))) for a, b in combinations(texts, 2) if lcs.distance(a, b) <= 0.3}
    assert {(r.a, r.b) for r in mining.distance_pairs(df).collect()} == want


def test_first_match_and_containment(spark):
    t = spark.createDataFrame([(1, "a <*>", 0), (2, "a b", 1), (3, "c {V}<*>", 2)], "template_id long, template_text string, ord int")
    texts = spark.createDataFrame([("a b",), ("a z",), ("c z",), ("none",)], "text string")
    assert {(r.text, r.template_id, r["pass"]) for r in match.first_match(texts, t).collect()} == {("a b", 1, 1), ("a z", 1, 1), ("c z", 3, 2)}
    assert [(r.coverer_id, r.covered_id) for r in match.containment(t).collect()] == [(1, 2)]
    assert [tuple(r) for r in match.last_coverer(t).collect()] == [(2, 1)]


def test_extract_asks_once(spark):
    texts = spark.createDataFrame([("user 1 in",), ("user 2 in",)], "content string")
    provider = lambda p: "`user <<id>> in`"
    got, cache = extract(texts, provider)
    assert {r.template for r in got.collect()} == {"user <*> in"} and cache.count() == 2

    def never(prompt):
        raise AssertionError("a prompt of the cache was asked again")

    assert extract(texts, never, cache)[0].count() == 2
    assert extract(texts)[0].where("template = content").count() == 2
    assert answered("user 1 in", "no idea") == "user 1 in"


def test_mining_gets_whole_messages(spark):
    """Every id and the props of every event reach the operators."""
    from sawmill import catalog

    sf = "/root/testdata/sf0.001"
    rows = {(r.dataset[0], r.line_no): r.content for r in catalog.mining_lines(spark, sf).collect()}
    events, orders = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("events", "orders"))
    assert len(rows) == len(events) + len(orders)
    for e in events:
        assert "props" in rows["d", e.event_id] and re.findall(r"\d+", rows["d", e.event_id].split("props")[1]) == re.findall(r"\d+", e.props)
    assert all(f"order {o.o_orderkey} of customer {o.o_custkey} " in rows["o", o.o_orderkey] for o in orders)


def test_distance_links_reach_every_sample(spark):
    """Members are linked to the head of their shape; pairs of heads are those of distance_pairs."""
    texts = [f"user {k} went {x} the long hill at noon" for x in ("over", "under") for k in range(40)] + ["other words here"]
    df = mining.samples(spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "dataset string, line_no long, content string"))
    links = mining.distance_links(df).collect()
    assert len(links) == 2 * 39 + 1 and sum(not r.member for r in links) == 1 and all(r.distance <= 0.3 for r in links)
    assert len({x for r in links for x in (r.a, r.b)}) == 80


def random_text(rng, words="ab kl mn ef gh", signs=(" ", " ", "; ", ". ", " (", " 12 ")):
    return "".join(rng.choice(words.split()) + rng.choice(signs) for _ in range(rng.randint(1, 7)))


def test_distances_equal_distance():
    """Many tables at once give what one pair at a time gives, empty texts and wildcards included."""
    rng = random.Random(3)
    pieces = ["ab", "kl", "mn", "x1", " ", " ", "; ", ". ", "<*>", "(<*>)", "12", "é", "/a"]
    a, b = (["".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 8, 20, 60]))) for _ in range(3000)] for _ in range(2))
    assert list(lcs.distances(a, b)) == [lcs.distance(x, y) for x, y in zip(a, b)]
    assert not len(lcs.distances([], []))


def plain_row_clusters(texts):
    n = len(texts)
    rows = np.zeros((n, n), np.float32)
    for i in range(n):
        for j in range(i):
            rows[i, j] = rows[j, i] = lcs.distance(texts[i], texts[j])
    rows, root = rows.astype(float), list(range(n))
    for i in range(n):
        for j in range(i):
            if np.sqrt(((rows[i] - rows[j]) ** 2).sum()) <= 0.3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [frozenset(texts[k] for k in range(n) if root[k] == root[i]) for i in range(n)]


def test_clusters_of_rows(spark):
    """Row clusters equal those on the whole matrix of distances, for sets of 3 to 120 texts."""
    rng, rows, want = random.Random(8), [], {}
    for k, size in enumerate([3, 4, 5, 8, 13, 20, 35, 60, 120]):
        base = [f"{rng.choice('pq')} starts with the job {x} on {y} of all nodes {z} in the rack" for x in "abcd" for y in ("one", "two", "ten") for z in ("now", "then", "soon", "late")] + ["other words", "12 34", "..."]
        texts = sorted({*rng.sample(base, min(size, len(base))), *(random_text(rng) for _ in range(size // 4))} if size > 5 else {f"job {x} started on node seven" for x in "abcde"[:size]})
        rows += [(f"s{k}", t, 1) for t in texts]
        want |= {(f"s{k}", t): c for t, c in zip(texts, plain_row_clusters(texts))}
    found = mining.row_clusters(spark.createDataFrame(rows, "dataset string, sample_text string, log_num int").withColumn("sample_id", F.xxhash64("dataset", "sample_text"))).collect()
    of = {}
    for r in found:
        of.setdefault((r.dataset, r.cluster), set()).add(r.sample_text)
    got = {(r.dataset, r.sample_text): frozenset(of[r.dataset, r.cluster]) for r in found}
    assert got == want and any(len(c) > 2 for c in want.values())


def test_fold_of_a_cluster_over_several_parts(spark, monkeypatch):
    """A cluster over FAN is folded by parts, each in the order of first lines, then the parts in the order of their numbers: what the docstring says, done plainly."""
    monkeypatch.setattr(mining, "FAN", 4)
    rng = random.Random(6)
    texts = sorted({"start " + " ".join(rng.sample(["of", "the", "long", "job", "now"], 4)) + f" at {k}" for k in range(41)})
    df = spark.createDataFrame([(7, k, t) for k, t in enumerate(texts)], "cluster long, first_line long, sample_text string").withColumn("sample_id", F.xxhash64("sample_text"))
    parts = -(-len(texts) // 4)
    rows = [(r.part, r.first_line, [lcs.tokenize(r.sample_text)]) for r in df.withColumn("part", F.expr(f"pmod(xxhash64(sample_id, 5), {parts}L)")).collect()]
    while True:
        folded = {}
        for part, line, runs in sorted(rows, key=lambda r: r[:2]):
            folded[part] = (min(line, folded[part][0]) if part in folded else line, lcs.fold(folded[part][1], runs) if part in folded else runs)
        if parts <= 1:
            break
        parts = -(-parts // 4)
        rows = [(p // 4, p, runs) for p, (_, runs) in folded.items()]
    (want,) = [runs for _, runs in folded.values()]
    ((_, got),) = [tuple(r) for r in mining.merged(df).collect()]
    assert [list(r) for r in got] == want


def test_links_between_shapes(spark):
    """Of the links between samples of different shapes, those that the heads of the shapes have too; signs belong to a shape, so few are missed."""
    rng = random.Random(12)
    texts = sorted({random_text(rng, signs=(" ", " ", "; ", ". ", " (", " 12 ", " 34 ", " 5 ")) for _ in range(400)})
    df = mining.samples(spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "dataset string, line_no long, content string"))
    shaped, firsts, _ = mining._shapes(df)
    shape = {r.sample_text: r.a for r in shaped.join(firsts, "shape").collect()}
    name = {r.sample_id: r.sample_text for r in df.collect()}
    linked = {frozenset((r.a, r.b)) for r in mining.distance_links(df).where("not member").collect()}
    by_id = [name[k] for k in sorted(name)]  # the measure of a pair depends on which one is first
    near = [(x, y) for i, y in enumerate(by_id) for x in by_id[:i] if shape[x] != shape[y] and lcs.distance(x, y) <= 0.3]
    caught = sum(frozenset((shape[x], shape[y])) in linked for x, y in near)
    assert len(near) > 100 and caught >= 0.97 * len(near), (caught, len(near))
    assert all(lcs.distance(name[min(p)], name[max(p)]) <= 0.3 for p in linked)


def linked_pairs(spark, texts, limit=0.3):
    """All pairs that the rows of distance_links speak of, and those that measuring every pair finds."""
    df = mining.samples(spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "dataset string, line_no long, content string"))
    name = {r.sample_id: r.sample_text for r in df.collect()}
    rows = mining.distance_links(df, limit).collect()
    assert all(r.distance == lcs.distance(name[r.a], name[r.b]) for r in rows if r.a < r.b or not r.member)
    of = {k: {k} for k in name}
    for r in rows:
        if r.member:
            of[r.a].add(r.b)
    found = []
    for r in rows:
        if not r.member:
            assert r.a < r.b and r.distance <= limit
            found += [frozenset((x, y)) for x in of[r.a] for y in of[r.b]] if r.whole else [frozenset((r.a, r.b))]
    for head in {r.a for r in rows if r.member and r.whole}:
        found += [frozenset((x, y)) for x in of[head] for y in of[head] if x < y]
    assert len(found) == len(set(found))
    want = {frozenset((x, y)) for x in name for y in name if x < y and lcs.distance(name[x], name[y]) <= limit}
    return set(found), want, rows


@pytest.mark.parametrize("block", [1024, 5])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    """No link between different texts is lost and none is made up, numbers that two texts share included (before: only the heads of shapes were tried)."""
    monkeypatch.setattr(mining, "PAIRED", block)
    rng = random.Random(12)
    parts = ["ab ", "kl ", "mn; ", "# ", "# ", "#. "]
    shapes = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 8))) for _ in range(40)]
    texts = sorted({re.sub("#", lambda _: rng.choice("1234"), t) for t in shapes for _ in range(10)})
    found, want, rows = linked_pairs(spark, texts)
    assert found == want and {(r.member, r.whole) for r in rows} == {(m, w) for m in (True, False) for w in (True, False)}


def test_links_that_need_a_shared_number(spark):
    """Texts whose order of words is another only with the same number, which the heads of their shapes don't share; many numbers go by bounds."""
    texts = [f"{k} {w} run of the {k + 3} job ends" for k in range(9) for w in ("first", "last")] + [f"the {k} {w} {k} {k + 1} {k % 3} {k} ends" for k in range(12) for w in ("a b", "b a", "c")] + ["12 34", "5 6", "7 8"]
    for limit in (0.1, 0.3, 0.6):
        found, want, _ = linked_pairs(spark, texts, limit)
        assert found == want


def test_links_of_like_messages_stay_few(spark):
    """Messages of few kinds give a row for each, and one for each pair of kinds, not all pairs."""
    texts = [f"order {k} of customer {k % 7} status {s} priority {p} total <*>" for k in range(60) for s in "OF" for p in ("1-URGENT", "5-LOW")]
    found, want, rows = linked_pairs(spark, texts)
    assert found == want and len(found) > 20_000 and len(rows) == len(texts) - 4 + 6 and all(r.whole for r in rows)


# Templates and texts --------------------------------------------------------------------------------


def plain_hits(texts, templates):
    return {(x, i, k) for x in texts for i, t, _ in templates for k, form in ((1, t), (2, t.replace("{V}", ""))) if (k == 1 or "{V}" in t) and matcher(form)(x)}


@pytest.mark.parametrize("block", [2000, 3])
def test_index_finds_every_match(spark, monkeypatch, block):
    """First matches and containment by the index on words equal all pairs, whether templates are broadcast or meet texts by a shuffle."""
    monkeypatch.setattr(match, "BLOCK", block)
    rng = random.Random(31)
    pieces = ["a", "bb", "a_b", "é1", " ", "  ", "-", ":", "<*>", "<*>", "{V}", "(", "."]
    texts = sorted({"".join(rng.choice([p for p in pieces if p not in ("<*>", "{V}")]) for _ in range(rng.randint(0, 6))) for _ in range(300)})
    patterns = sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"<*>", "a <*>", "<*> bb", "{V}<*>"})
    templates = [(k, t, rng.randint(0, 9) * 1000 + k) for k, t in enumerate(patterns)]
    ords = {i: o for i, _, o in templates}
    want = {}
    for x, i, k in plain_hits(texts, templates):
        want[x] = min(want.get(x, (9, 0, 0)), (k, ords[i], i))
    df = spark.createDataFrame(templates, "template_id long, template_text string, ord int")
    got = {r.text: (r["pass"], r.template_id) for r in match.first_match(spark.createDataFrame([(x,) for x in texts], "text string"), df).collect()}
    assert got == {x: (k, i) for x, (k, _, i) in want.items()}
    covers = {(i, j) for i, t, _ in templates for j, x, _ in templates if x != t and "<*>" in t and matcher(t)(x)}
    assert {tuple(r) for r in match.containment(df).select("coverer_id", "covered_id").collect()} == covers and len(covers) > 20


def test_a_message_on_half_of_the_lines(spark, monkeypatch):
    """Lines of a hot sample are not shuffled by it, lines without a sample stay, and rows come out as by a plain join."""
    monkeypatch.setattr("sawmill.plans.tables.HOT", 8)
    monkeypatch.setattr("sawmill.plans.tables.LEAST_HOT", 2)
    lines = spark.createDataFrame([(k, None if k % 10 == 0 else 1 if k % 2 else k) for k in range(200)], "line_no long, sample_id long")
    samples = spark.createDataFrame([(1, 5, 100)] + [(k, 5 + k % 3, 1) for k in range(2, 150, 2)], "sample_id long, template_id long, log_num long")
    names = spark.createDataFrame([(5, "x {V}＜"), (6, "y")], "template_id long, template_text string")
    of, text = {s: t for s, t, _ in [tuple(r) for r in samples.collect()]}, {5: "x <", 6: "y"}
    for some in (samples, samples.drop("log_num")):
        got = match.structured(lines, some, names)
        assert {(r.line_no, r.sample_id, r.EventId, r.EventTemplate) for r in got.collect()} == {(r.line_no, r.sample_id, of.get(r.sample_id), text.get(of.get(r.sample_id))) for r in lines.collect()}
        assert got.count() == 200


def test_parse_shuffles_lines_once(spark):
    """The plan of a parsed log has one scan of the saved lines for each side of hot and other samples, and no join of lines with lines."""
    from sawmill.operators.parse import parse

    rows = spark.createDataFrame([("d", k, f"INFO: user {k % 3} came in from 10.0.0.{k}") for k in range(40)] + [("d", 99, "no header")], "dataset string, line_no long, value string")
    log, found = parse(rows, "<Level>: <Content>")
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    got = log.orderBy("LineId").collect()
    assert len(got) == 41 and got[-1].EventId is None and got[-1].LineId == 99 and all(r.EventTemplate for r in got[:-1])
    assert log.columns == ["dataset", "LineId", "Level", "Content", "EventId", "EventTemplate"] and found.agg(F.sum("Occurrences")).first()[0] == 40


def test_few_templates_match_without_a_shuffle(spark, monkeypatch):
    """A few templates are tried where the rows are (before: an explode, three shuffles and a join); the result is that of the index on words."""
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "a z", "a z", "c{V} z", "c z", "none", "", None, "a b\nc"])], "line_no int, content string")
    names = spark.createDataFrame([(1, "a <*>", 3), (2, "a b", 4), (3, "c{V} <*>", 1), (4, "<*> z", 2), (5, "a z", 3)], "template_id long, template_text string, ord int")
    few = match.with_first_match(texts, "content", names)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    got = {(r.line_no, r.template_id, r["pass"]) for r in few.collect()}
    monkeypatch.setattr(match, "FEW", 0)
    many = match.with_first_match(texts, "content", names)
    assert got == {(r.line_no, r.template_id, r["pass"]) for r in many.collect()} and len(got) == 5
    assert dict(few.dtypes) == dict(many.dtypes)


def test_alike_pairs_are_measured_once(monkeypatch):
    """Texts that differ in tokens that the other text lacks take one table, over several calls too; the distances are those of each pair."""
    tables, real = [], lcs._distances
    monkeypatch.setattr(lcs, "_distances", lambda a, b: tables.extend(a) or real(a, b))
    head, texts = "user 1 of 2 went home", [f"user {k} of {k * 3} went home" for k in range(200)]
    known = {}
    got = [*lcs.distances([head] * 100, texts[:100], known), *lcs.distances([head] * 100, texts[100:], known)]
    assert got == [lcs.distance(head, t) for t in texts] and len(tables) < 8
    words = ["user went far home", "user 7 far home", "user ran far home"]
    assert list(lcs.distances([words[0]] * 3, words)) == [lcs.distance(words[0], t) for t in words]


def test_shapes_tell_tokens_but_for_numbers(spark):
    rng = random.Random(4)
    pieces = ["ab", "kl", "1", "22", "é", "٣", "-", "/", "\\", ".", "_", " ", " ", "; ", "<*>", "(<*>)", "0", "\n"]
    texts = sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(3000)})
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "dataset string, sample_id long, sample_text string")
    shapes = {r.sample_id: r.shape for r in mining._shapes(df)[0].collect()}
    number = lambda t: not lcs.is_word(t) and re.match(r"[\w\-\\/.]*\w", t)
    plain = [tuple("0" if number(t) else t for t in lcs.tokenize(x)) for x in texts]
    assert len(set(plain)) == len(set(shapes.values())) == len({(p, shapes[i]) for i, p in enumerate(plain)})


def test_joined_tokens_are_the_tokens(spark):
    texts = ["", "a b", "order 1; <*> é.x", "a\nb", f"x{lcs.BAR}y 2", lcs.BAR]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mining._joined_tokens(F.col("t")).alias("j")).collect()
    assert all(lcs.parted(r.j) == lcs.tokenize(r.t) for r in rows)


def test_folding_steps_serve_all_parts(monkeypatch):
    """Parts of alike texts are folded as the first was; with few steps kept the runs are the same."""
    import pyarrow as pa

    calls, real = [], lcs.fold
    monkeypatch.setattr(lcs, "fold", lambda *a: calls.append(1) or real(*a))
    texts = [[f"user {100 * p + k} went {'over' if k % 2 else 'under'} the hill" for k in range(50)] for p in range(40)]
    rows = [(1, p, k, lcs.joined(lcs.tokenize(t))) for p, part in enumerate(texts) for k, t in enumerate(part)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["cluster", "part", "first_line", "tokens"])
    got = [r for b in mining._folding(False, True)([batch.slice(0, 777), batch.slice(777)]) for r in b.to_pylist()]
    assert [r["runs"] for r in got] == [lcs.fold_all(map(lcs.tokenize, part)) for part in texts] and [r["first_line"] for r in got] == [0] * 40
    calls.clear()
    list(mining._folding(False, True)([batch]))
    assert len(calls) < 40 * 2.2  # 40 first steps are each their own; four and more for a part before
    monkeypatch.setattr(mining, "STEPS", 2)
    assert got == [r for b in mining._folding(False, True)([batch]) for r in b.to_pylist()]
