import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sawmill.functions import cleanup as C
from sawmill.functions import text as T
from sawmill.functions.regexes import compile_format, java, template_pattern
from sawmill.operators import lcs
from sawmill.sources.logs import parse_header, read_lines, read_scored, write_csv
from sawmill.sources.presets import COLLECTIONS, SHARED_MASKS

TEXTS = ["", " ", "a b", "Ünï cödé_x 12", "x\ty　z", "10.0.0.1:80 at host-1.example.com", "12345", "root 0x1F Mon", "a<b>{c}", "line\nbreak", "(<*>) <*>"]


def one(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(column).collect()]


def py_mask(text, patterns):
    for p in patterns:
        new = re.sub(p, "<*>", text)
        text = new if re.search("[a-zA-Z]", new.replace("<*>", "")) else text
    return text


def test_masks_equal_python(spark):
    df = T.mask(spark.createDataFrame([(t,) for t in TEXTS], "t string"), "t", SHARED_MASKS)
    assert [r[0] for r in df.collect()] == [py_mask(t, SHARED_MASKS) for t in TEXTS]


def test_masking_plan_stays_small(spark):
    df = T.mask(spark.createDataFrame([("a 1",)], "t string"), "t", SHARED_MASKS * 2).where("t like '%a%'")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_tokens_equal_python_and_lose_nothing(spark):
    got = one(spark, TEXTS, T.tokens(F.col("t")))
    assert got == [lcs.tokenize(t) for t in TEXTS]
    assert ["".join(g) for g in got] == TEXTS


def test_reserved_characters_come_back(spark):
    marked = one(spark, TEXTS, T.escape_reserved(F.col("t")))
    assert not any(set("<>{}") & set(m) for m in marked)
    assert one(spark, TEXTS, T.restore_reserved(F.concat(T.escape_reserved(F.col("t")), F.lit("{V}")))) == TEXTS


def test_words(spark):
    assert one(spark, ["<*>", "a <*>", "12 x", "<*>1"], T.has_word(F.col("t"))) == [False, True, True, False]
    assert one(spark, ["a", "a b", "", "é_1"], T.one_word(F.col("t"))) == [True, False, True, True]


@pytest.mark.parametrize(("template", "text", "fits"), [("a <*> b", "a b", True), ("a <*> b", "a x y b", True), ("a <*>", "a x\ny", False), ("[<*>] (x)", "[1] (x)", True), ("<*>", "", True), ("a.b", "axb", False), ("a <*> b", "a  c", False)])
def test_template_match(spark, template, text, fits):
    assert one(spark, [text], F.col("t").rlike(template_pattern(template))) == [fits]


def test_formats():
    h = compile_format(COLLECTIONS["Linux"][0])
    assert h.fields == ("Month", "Date", "Time", "Level", "Component", "PID", "Content") and h.groups == (1, 2, 3, 4, 5, 7, 8) and h.optional == {"PID"}
    for header, masks in COLLECTIONS.values():
        assert re.compile(compile_format(header).pattern)
        assert all(java(m) for m in masks)


def test_headers(spark):
    lines = spark.createDataFrame([(1, "Jun 9 06:06:20 combo sshd[123]: hello: x"), (2, "Jun 9 06:06:20 combo kernel: up"), (3, "nothing"), (4, "Jun 9 06:06:20 combo k\x01: a\x01b"), (5, "\x01 nothing"), (6, "")], "line_no int, value string")
    kept = parse_header(lines, COLLECTIONS["Linux"][0]).orderBy("line_no").collect()
    assert [(r.Component, r.PID, r.Content) for r in kept] == [("sshd", "123", "hello: x"), ("kernel", None, "up"), (None, None, None), ("k\x01", None, "a\x01b"), (None, None, None), (None, None, None)]
    assert parse_header(lines, COLLECTIONS["Linux"][0], drop_unmatched=True).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("one \n two\n\nfour\n")
    got = read_lines(spark, str(tmp_path / "a.log"), limit=3).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in got] == [(1, "one"), (2, "two"), (3, "")]
    write_csv(spark.createDataFrame([('say "x"', None)], "a string, b string"), str(tmp_path / "csv"))
    assert [tuple(r) for r in read_scored(spark, str(tmp_path / "csv"), fill=True).collect()] == [('say "x"', "")]


def test_line_numbers_of_files_in_several_splits(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 3000)):
        (tmp_path / f"{name}.log").write_text("".join(f"{name} line {i}\n" for i in range(1, n + 1)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    try:
        rows = read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 2
        assert rows.where("value <> concat(substring_index(value, ' ', 1), ' line ', line_no)").count() == 0 and rows.count() == 8000
    finally:
        spark.conf.set(key, before)


def test_cleanup(spark):
    rows = ["a  b ", "open /var/log x", "x=TRUE groot root.a", "<*>.<*>.<*>", "##<*>## #<*>#<*>#", "<*>:<*>:<*>", "<*><*><*>"]
    df = C.cleaned(spark.createDataFrame([(t,) for t in rows], "t string"), "t")
    assert [r[0] for r in df.collect()] == ["a b", "open <*> x", "x=<*> groot <*>.a", "<*>", "<*> <*><*>#", "<*>", "<*>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_common_runs_are_common(a, b):
    runs = lcs.common_runs(a, b)
    assert lcs.gaps(a, runs) is not None and lcs.gaps(b, runs) is not None
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    assert sum(map(len, runs)) == best[-1][-1]


def test_weights_and_folds():
    """Words weigh more than signs and spaces; runs that were parted stay so."""
    assert [lcs.weight(t) for t in ("node", "<*>", "(<*>)", " ", ",", "a/b-c")] == [4, 4, 4, 1, 4, 4]
    a, b = list("x"), [" ", " ", " ", "x"]
    assert lcs.common_runs([*"x", " ", " "], [" ", " ", "x"]) == [[" ", " "]] and lcs.common_runs([*"x", " ", " "], [" ", " ", "x"], weighted=True) == [["x"]]
    assert lcs.common_runs(a, b) == [["x"]]
    assert lcs.fold([["a", "b"], ["c"]], [["a", "b", "c"]]) == [["a", "b"], ["c"]]
    assert lcs.fold([["a"], ["b"]], [["a", "b"]]) == [["a"], ["b"]] and lcs.fold([], [["a"]]) == []
    many = [[c] for c in "abcdefgh"]
    assert lcs.fold(many, many[::2], weighted=True) == many[::2] and lcs.fold(many[1:], [[*"abcdefgh"]], weighted=True) == many[1:]


def test_distances():
    assert lcs.distance("Connection from <*> closed", "Connection from <*> refused") == 0.25
    assert lcs.distance("12", "13") == 1
    assert lcs.repaired("user 7 did it", "user <*> did it") == "user <*> did it"


def test_placeholders_of_whole_pages(spark):
    """Against plain Python on whole pages; the first 400 characters alone give other texts."""
    from sawmill import catalog

    sf = "/root/testdata/sf0.001"
    rule = re.compile(r"(<<(.*?)>>)+|(<(.*?)>)+")
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = {r.page_id: rule.sub("<*>", f"{r.url} <<a b>><<c>> <d> {r.html}") for r in pages}
    assert {r.page_id: r.text for r in catalog.QUERIES["normalize_placeholders_whole"](spark, sf).collect()} == want
    assert any(rule.sub("<*>", f"{r.url} <<a b>><<c>> <d> {r.html[:400]}") != want[r.page_id] for r in pages)
