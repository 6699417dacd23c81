"""The pipeline, stage by stage: each stage's result from its own input, against plain versions; and what stages make of odd columns and long texts."""

import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_documents import plain_components, plain_contamination, plain_passage_dedup, rows_of, words  # noqa: E402

from sawmill.llm import decontam, packing, quality, secrets, warc  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """{stage: (input, result)}, each result written and read as ``run`` does."""
    import corpus_pipeline

    out, docs, path = {}, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{path}/{name}")
        before, docs = docs, spark.read.parquet(f"file://{path}/{name}")
        out[name] = before, docs
    return out


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    first = stages["quality"][0].columns
    assert all(stages[s][1].columns == first for s in list(stages)[:-1])
    assert all(got.count() for _, got in stages.values())


def test_quality_stage(stages, spark):
    """Rows go by the score that the operator gives them, and are as they came."""
    before, got = stages["quality"]
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(map(repr, got.collect())) == sorted(repr(r) for r in before.collect() if scores[r.doc_id])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in got.collect()}
    good, bad = ([d in kept for d, q in labels.items() if q == k and zlib.crc32(str(d).encode()) % 4 == 2] for k in (1, 0))
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.2


def test_line_dedup_stage(stages):
    before, got = stages["line_dedup"]
    assert sorted(map(repr, rows_of(got))) == sorted(map(repr, plain_passage_dedup(rows_of(before))))
    assert got.where("n_chars <> length(text)").count() == 0


def test_near_dedup_stage(stages):
    """One document of each group of near copies stays, the one of the smallest id, with all of its columns."""
    before, got = stages["near_dedup"]
    groups = plain_components(rows_of(before))
    assert len(set(groups.values())) < len(groups)
    assert sorted(map(repr, got.collect())) == sorted(repr(r) for r in before.collect() if groups[r.doc_id] == r.doc_id)


def test_decontamination_stage(stages, spark):
    """No phrase is left, texts without one are untouched, and what is left is what was there, in its order."""
    before, got = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    old, new = dict(rows_of(before)), dict(rows_of(got))
    assert set(old) == set(new)
    hit = {d for d, _, n, *_ in plain_contamination(list(old.items()), items) if n}
    assert hit and not any(n for _, _, n, *_ in plain_contamination(list(new.items()), items))
    for d, text in new.items():
        assert (text != old[d]) == (d in hit)
        left = iter(words(old[d]))
        assert all(w in left for w in words(text))


def test_packing_stage(stages):
    """Every token of every document is in one sequence, gapless, in as few sequences as its own plan says."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, got = stages["packing"]
    lengths, spans = defaultdict(int), defaultdict(list)
    for r in got.collect():
        lengths[r.doc_id] += r.length
        spans[r.sequence_id].append((r.offset, r.length))
    assert {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows_of(before)} == dict(lengths)
    for places in spans.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(spans) <= -(-sum(lengths.values()) // 2048) + max(2, len(spans) // 50)


# Odd columns and long texts ---------------------------------------------------------------------------

NAMES = ["row", "spans", "length", "piece", "start", "offset", "sequence_id", "_rank", "hits", "n_words", "item_id", "words"]


def test_columns_of_any_name(spark, sf):
    """Decontamination carries them through; packing ignores them."""
    phrase = " ".join(f"w{i}" for i in range(12))
    rows = spark.createDataFrame([(1, f"before {phrase} after", *NAMES), (2, "clean text", *NAMES), (None, phrase, *NAMES)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES))
    items = spark.createDataFrame([(9, phrase, "x")], "item_id long, text string, doc_id string")
    got = decontam.without_benchmark(rows, items)
    assert got.columns == rows.columns
    assert sorted(r.text.split() for r in got.collect()) == [[], ["before", "after"], ["clean", "text"]] and all(tuple(r)[2:] == tuple(NAMES) for r in got.collect())
    assert {r.doc_id for r in packing.best_fit_packing(rows).collect()} == {1, 2, None}


def test_long_texts(spark, sf):
    """One text of a million characters among short ones goes through operators 2, 4, 6 and 7 whole."""
    long = " ".join(f"word{i % 977} token=k{i:013d}" for i in range(30_000))
    rows = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id long, text string")
    found = secrets.all_candidates(rows).agg(F.count("*").alias("n"), F.max("start").alias("at")).first()
    assert found.n == 30_000 and found.at > len(long) - 40
    scores = {r.doc_id: r.score for r in quality.quality_scores(rows, sf("labels")).collect()}
    assert set(scores) == {1, 2, 3} and all(0 <= s <= 1 for s in scores.values())
    got = packing.best_fit_packing(rows).where("doc_id = 1").agg(F.sum("length").alias("n"), F.max("length").alias("most"), F.count("*").alias("pieces")).first()
    assert got.most == 2048 and got.pieces == -(-got.n // 2048)
    pages = spark.createDataFrame([(1, "http://a.example/1", long), (2, "http://a.example/2", long), (3, "http://a.example/3", None)], "page_id long, url string, html string")
    assert {(r.page_id, r.payload_bytes, r.refers_to) for r in warc.page_captures(spark, pages).collect()} == {(1, len(long), None), (2, len(long), 1), (3, 0, None)}
