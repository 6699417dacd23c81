import gzip
import hashlib
import io
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sawmill.llm import embed, warc
from sawmill.llm.common import components, ranked, shared_dir


def test_captures_equal_pages(spark, sf):
    long = "<html>" + "é" * 80
    rows = [(5, "http://a.example/x y", long), (3, None, long), (3, None, long), (9, "http://b.example/", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", long), (6, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 9)]
    for pages in (spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string"), sf("pages")):
        data = [(r.page_id, (r.html or "").encode()) for r in pages.select("page_id", "html").collect()]
        first = defaultdict(list)
        for i, b in data:
            if len(b) >= 100 and i is not None:
                first[b].append(i)
        want = []
        for i, b in data:
            o = min(first[b]) if len(b) >= 100 and first[b] and min(first[b]) != i else None
            want.append((i or 0, len(b), hashlib.sha256(b).hexdigest(), "response" if o is None else "revisit", o or 0, None if o else b))
        got = warc.page_captures(spark, pages, payloads=True).collect()
        assert sorted(want, key=str) == sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0, None if r.payload is None else bytes(r.payload)) for r in got), key=str)
    assert warc.page_captures(spark, sf("pages").where("false")).count() == 0


def test_transactions_across_files(spark, tmp_path):
    def record(kind, name, extra, block):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n" + "".join(f"{k}: {v}\r\n" for k, v in extra) + f"Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    answer = record("response", "r1", [("Content-Type", "application/http")], b"HTTP/1.1 200 OK\r\n\r\nbody")
    request = record("request", "q1", [("WARC-Concurrent-To", "<r1>")], b"GET / HTTP/1.1\r\n\r\n")
    lone = record("metadata", "m9", [("WARC-Concurrent-To", "<gone>"), ("Content-Type", "application/warc-fields")], b"k: v\r\n")
    (tmp_path / "a.warc").write_bytes(request + lone)  # plain
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(answer))
    files = spark.createDataFrame([(str(tmp_path / n), 1) for n in ("a.warc", "b.warc.gz")], "path string, records long")
    got = {r.capture: r for r in warc.transactions(warc.read(files, f"file://{tmp_path}", payloads=True)).collect()}
    assert got["<r1>"].request.record_id == "<q1>" and bytes(got["<r1>"].response.payload) == b"body"
    assert got["<gone>"].response is None and got["<gone>"].metadata.fields == {"k": "v"}


def test_transactions_named_by_responses_and_several_identifiers(spark, tmp_path):
    """A response that names its request, a metadata record that names both, and a revisit from elsewhere."""

    def record(kind, name, extra, block):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n" + "".join(f"{k}: {v}\r\n" for k, v in extra) + f"Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    data = record("request", "q1", [], b"GET / HTTP/1.1\r\n\r\n") + record("response", "r1", [("WARC-Concurrent-To", "<q1>")], http)
    data += record("metadata", "m1", [("WARC-Concurrent-To", "<q1>"), ("WARC-Concurrent-To", "<r1>"), ("Content-Type", "application/warc-fields")], b"k: v\r\n")
    data += record("revisit", "v2", [("WARC-Refers-To", "<r1>"), ("WARC-Refers-To-Target-URI", "http://a.example/")], b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / "a.warc"), 1)], "path string, records long")
    got = sorted(warc.transactions(warc.read(files, f"file://{tmp_path}")).collect(), key=lambda r: r.response.record_id)
    assert [(r.request and r.request.record_id, r.response.record_id, r.metadata and r.metadata.fields, r.response.refers_to, r.response.refers_to_uri) for r in got] == [("<q1>", "<r1>", {"k": "v"}, None, None), (None, "<v2>", None, "<r1>", "http://a.example/")]


def test_revisits_name_their_original(spark):
    page = "<html>" + "a" * 200
    folder = f"{shared_dir(spark)}/warc-test"
    pages = spark.createDataFrame([(1, "http://a.example/one", page), (2, "http://b.example/two", page)], "page_id long, url string, html string")
    got = warc.transactions(warc.read(warc.write(pages, folder), folder)).where("response.type = 'revisit'").collect()
    assert [(r.response.target_uri, r.response.refers_to_uri) for r in got] == [("http://b.example/two", "http://a.example/one")]


def test_cut_archives_are_errors():
    with pytest.raises(ValueError):
        list(warc._records(io.BytesIO(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc")))


def plain_links(rows):
    ok = [(i, l, np.array(v, float)) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, root = defaultdict(int), {i: i for i, _, _ in rows if i is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, (i, l, v) in enumerate(ok):
        for j, m, w in ok[:k]:
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return n, {i: find(i) for i in root}


def test_vectors_of_any_size(spark):
    """Parallel vectors link and others don't, however large or small their numbers."""
    rows = [(1, [1e160, 2e160], "a"), (2, [2e160, 4e160], "a"), (3, [1e-170, 2e-170], "a"), (4, [2e-170, -1e-170], "a"), (5, [0.0, 0.0], "a"), (6, [1.0, 2.0], "b")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 64))
    near = [(c + rng.normal(size=64) * s * 0.25).tolist() for c in centres for s in (0, 0.3, 0.6, 1.0)]
    rows = [(k, v, k % 2) for k, v in enumerate(near * 2)]
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [math.nan] * 64, 1), (903, [None, *[1.0] * 63], 1), (904, near[0], None), (None, near[0], 0), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n int")
    n, root = plain_links(rows)
    got = {r.vec_id: r for r in embed.near_vectors(df).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].n_links for i in root) >= 0.9 * sum(n.values())
    assert all(got[i].n_links <= n[i] for i in root)
    exact = [i for i in root if got[i].n_links == n[i] and got[i].component_id == root[i]]
    assert len(exact) >= 0.9 * len(root)
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, None))
    assert got[906].component_id == 905 and got[905].n_links == 1
    assert embed.near_vectors(df.where("false")).count() == 0


def test_vectors_and_buckets_are_not_broadcast(spark, monkeypatch):
    """No table that grows with the vectors passes through the driver, however small its files are (before: buckets, links, roots and vectors)."""
    from sawmill.plans import tables

    plans, save = [], tables.saved

    def seen(df, name="part"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, name)

    for module in (embed, tables):
        monkeypatch.setattr(module, "saved", seen)
    monkeypatch.setattr(tables, "FEW", 10)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(40, 16)), 3, axis=0)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x + rng.normal(size=x.shape) * 0.05)]
    found = embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("BroadcastExchange" in p for p in plans) and sum(p.count("SortMergeJoin") for p in plans) > 5
    assert sum(r.n_links for r in found.collect()) == 240


def test_recall_on_hard_pairs():
    """Pairs just over the threshold, found by the tables' rule: within RADIUS bits of codes of the whole."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = embed.Quantiser(x)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.93, 1.0, len(x))[:, None]
    far = np.bitwise_count(q.codes(x) ^ q.codes(cos * x + np.sqrt(1 - cos**2) * noise))
    assert (far <= embed.RADIUS).mean() >= 0.9


def test_components_and_ranks(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60) if k % 20 != 19] + [(5, 5), (None, 3), (100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got[19] == 0 and got[39] == 20 and got[59] == 40 and got[101] == 100 and len(got) == 62
    df = spark.range(1000).repartition(7).withColumn("g", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3))
    seen = defaultdict(list)
    for r in ranked(df, "g", "at").collect():
        seen[r.g].append(r["at"])
    assert all(sorted(v) == list(range(len(v))) for v in seen.values()) and sum(map(len, seen.values())) == 1000
    assert shared_dir(spark).startswith("file:")
