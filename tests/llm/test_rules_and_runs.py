"""Quality rules, the filter audit and periodic runs against plain versions, on edge cases and on the smallest tables."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sawmill.llm import filteraudit, periodic, qualityrules

WORD = re.compile("[^\x20\x09-\x0d]+")


def text_rows(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["edge", "table"])
def docs(request, edge, sf):
    return edge if request.param == "edge" else sf("documents")


# Quality rules ------------------------------------------------------------------------------------


def plain_statistics(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    count = lambda signs: sum(map(text.count, signs))
    ascii_signs = [chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in " \t\n\x0b\x0c\r"]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": count("#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_lines": len(lines), "n_distinct": len(set(words)),
        "n_uppers": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_digits": count("0123456789"), "n_signs": count(ascii_signs),
    }


def test_statistics(docs):
    rows = qualityrules.statistics(docs).select("row.doc_id", "row.text", *qualityrules.STATISTICS, qualityrules.base_failed().alias("bad")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = plain_statistics(r.text or "")
        assert {k: r[k] for k in want} == want
        assert r.bad == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab \n#Aé\t0", max_size=60), max_size=5))
def test_statistics_of_any_texts(texts):
    import pyarrow as pa

    from sawmill.llm import textbytes

    got = qualityrules.text_statistics(*textbytes.text_buffer(pa.array(texts, pa.string())))
    for k, text in enumerate(texts):
        want = plain_statistics(text)
        assert {c: int(got[c][k]) for c in want} == want


def test_a_long_text_takes_time_in_proportion():
    from sawmill.llm import textbytes
    import pyarrow as pa

    def took(n):
        buffer = textbytes.text_buffer(pa.array([" ".join(f"w{i * 7919 % 4001}\n" for i in range(n))]))
        began = time.perf_counter()
        qualityrules.text_statistics(*buffer)
        return time.perf_counter() - began

    took(10_000)
    assert took(400_000) < 10 * max(took(100_000), 0.05)


def plain_verdict(rules, values):
    for rule in rules.rules:
        if all(values[c.feature] > c.threshold if c.above else values[c.feature] <= c.threshold for c in rule):
            return rules.label
    return 1 - rules.label if rules.rules else 1


def test_list_decides_as_it_reads(sf):
    """The Spark conditionals give what the list gives read rule by rule, and labels that were held out are met."""
    docs, labels = sf("documents"), sf("labels")
    rules = qualityrules.decision_list(docs, labels)
    assert rules.rules and rules.label == 0 and rules.text().startswith("if ") and "else: 1" in rules.text()
    features = qualityrules._features()
    found = qualityrules.statistics(docs).select("row.doc_id", *(c.alias(k) for k, c in features.items()), rules.verdict().alias("v"), rules.rule().alias("rule")).collect()
    for r in found:
        assert r.v == plain_verdict(rules, r.asDict())
    judged = qualityrules.quality_rules(docs, labels).join(labels, "doc_id").withColumn("held", qualityrules.held_out(F.col("doc_id")))
    left = judged.where("held and not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in left}
    assert kept[1] >= 0.95 and kept.get(0, 0) <= 0.2
    assert judged.where("base_failed and kept").count() == 0


def test_covering_finds_a_conjunction():
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"a": rng.random(4000), "b": rng.random(4000), "c": rng.random(4000)})
    y = (~((x.a > 0.8) & (x.b <= 0.5)) & ~(x.c > 0.95)).to_numpy().astype(int)
    rules = qualityrules.learned(x, y, np.arange(4000) % 3 == 0)
    got = np.array([plain_verdict(rules, v) for v in x.to_dict("records")])
    assert rules.label == 0 and len(rules.rules) >= 2 and (got == y).mean() > 0.99
    # noise that no threshold explains gives no rule of PRECISION, and so no list
    assert not qualityrules.learned(x, (rng.random(4000) > 0.3).astype(int), np.arange(4000) % 3 == 0).rules


def test_rules_without_labels_keep_all(edge, sf):
    for labels in (sf("labels").where("false"), edge.select("doc_id", F.lit(1).alias("quality")), edge.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("quality"))):
        assert not qualityrules.decision_list(edge, labels).rules
        assert qualityrules.quality_rules(edge, labels).where("kept = base_failed").count() == 0
    assert qualityrules.quality_rules(edge.where("false"), sf("labels")).count() == 0


def test_rules_carry_columns_of_any_name(spark):
    names = ["row", "rule", "kept", "n_words", "base_failed", "quality", "_text", "words"]
    text = " ".join(f"w{i}" for i in range(80))
    rows = spark.createDataFrame([(1, text, *names), (1, text, *names), (2, "short", *names), (None, text, *names)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None)], "doc_id long, quality int")
    got = qualityrules.good_by_rules(rows, labels)
    assert got.columns == rows.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 1), (False, 1), (True, 0)]


# Filter audit -------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    first, good, toxic = {}, set(), set()
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, q, x in labels:
        good |= {d} if q == 1 else set()
        toxic |= {d} if x == 1 else set()
    of = defaultdict(list)
    for d, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": d is not None and d > first[t]}
        of[part or ""].append((fails, d is not None and d in good, d is not None and d in toxic))
    out = []
    for part, found in of.items():
        removed_by = Counter()
        lines = []
        for order in map("".join, permutations("ABCDE")):
            left = found
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                before = set(order[: step - 1])
                left = [x for x in left if not x[0][f]]
                removed_by[f] += len(gone)
                redundant = sum(x[0][f] and any(x[0][b] for b in before) for x in found)
                lines.append((f, (part, order, step, len(left), len(gone), redundant, sum([k for k in "ABCDE" if x[0][k]] == [f] for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone))))
        out += [(*line, removed_by[f]) for f, line in lines]
    return sorted(out)


def audited(documents, labels):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r[c] for c in names) for r in filteraudit.filter_audit(documents, labels).collect())


def test_audit_of_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(220))
    rows = [
        (1, long, "en"), (2, long, "de"), (3, long, "en"), (3, long, "en"), (None, long, "en"), (None, long, None), (4, None, None), (5, "", ""), (6, "", None), (7, long.upper(), "en"), (8, long + " # x", "fr"), (9, "a " * 300, "fr"), (10, "é" * 99 + "ABC", "it"), (11, "é" * 97 + "ABC", "it"),
    ]
    labels = [(1, 1, 0), (3, 0, 1), (3, 1, 0), (5, 1, 1), (None, 1, 1), (7, None, 1), (99, 1, 1), (9, 0, 0)]
    # columns of other names, some of them those that the audit uses inside
    df = spark.createDataFrame([(*r, 1, "k", 7) for r in rows], "doc_id long, text string, lang string, part int, digest string, n int")
    assert audited(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == plain_audit(rows, labels)
    assert audited(df.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == []


def test_audit_of_hot_texts(spark, monkeypatch):
    """Texts and doc_ids that hold a third of all rows go by the broadcast side of the join, with the same result."""
    monkeypatch.setattr("sawmill.plans.tables.HOT", 8)
    monkeypatch.setattr("sawmill.plans.tables.LEAST_HOT", 2)
    rows = [(k if k % 3 else 7, "copy" if k % 2 else f"text {k}", "en" if k % 5 else "de") for k in range(1, 90)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 90, 4)] + [(7, 1, 1)]
    labels = [(a, b, int(c)) for a, b, c in labels]
    assert audited(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == plain_audit(rows, labels)


def test_audit_of_any_filters(spark):
    rows = spark.createDataFrame([("p", bool(k & 1), bool(k & 2), k) for k in range(8)], "part string, X boolean, Y boolean, m long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.m_lost, r.shapley) for r in filteraudit.interactions(rows, "XY", ("m",)).collect()}
    assert got == {("XY", 1): (4, 4, 0, 2, 16, 6), ("XY", 2): (2, 2, 2, 2, 8, 6), ("YX", 1): (4, 4, 0, 2, 18, 6), ("YX", 2): (2, 2, 2, 2, 6, 6)}


# Periodic runs ------------------------------------------------------------------------------------


def plain_runs(w):
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_periodic(doc_id, text):
    w = WORD.findall(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_texts(docs):
    rows = text_rows(docs)
    got = periodic.periodic_texts(docs, plant=True).drop("runs", "collapsed").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_periodic(d, t)) for d, t in rows)


def test_planted_runs_are_found(spark):
    """Ids whose texts get a repeated end, with all that periods of one word and more can give."""
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 5, 6, 7, 24, 90)]
    rows = [(d, t) for d in range(400) for t in texts if zlib.crc32(str(d).encode()) % 10 == 0]
    got = periodic.periodic_texts(spark.createDataFrame(rows, "doc_id long, text string"), plant=True).drop("runs", "collapsed").collect()
    want = [plain_periodic(d, t) for d, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and any(r[1] for r in want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=9), st.integers(0, 12), st.lists(st.integers(0, 2), max_size=9)), max_size=4))
def test_runs_of_any_texts(parts):
    texts = [np.array(a + b * 1 + a * k + b, np.int64) for a, k, b in parts]
    assert periodic.periodic_runs(texts) == [plain_runs(list(t)) for t in texts]


def test_runs_of_long_texts():
    """Time follows n log n where all words are equal, where none are, and where a third of them lies between two odd words."""
    for make in (lambda n: np.zeros(n, np.int64), lambda n: np.arange(n), lambda n: (np.arange(n) % (n // 3) == 0).astype(np.int64), lambda n: np.tile(np.arange(1000), n // 1000)):
        began = time.perf_counter()
        runs = periodic.periodic_runs([make(100_000)])[0]
        assert time.perf_counter() - began < 20
        assert len(runs) == len({(s, n) for s, n, _ in runs})
    assert runs == [(0, 100_000, 1000)]


def test_collapsed_text_keeps_one_period(spark):
    df = spark.createDataFrame([(3, "go " + "a b c " * 5 + "end"), (4, None), (5, "x x x x x")], "doc_id long, text string")
    got = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in periodic.periodic_texts(df).collect()}
    assert got == {3: ("go a b c end", [(1, 15, 3)]), 4: ("", []), 5: ("x x x x x", [])}
    assert periodic.periodic_texts(df.where("false")).count() == 0
