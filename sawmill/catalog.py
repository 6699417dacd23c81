"""The registered queries of the log operators, with the SQL that gives the same rows.

Log lines are rendered from the tables: ``events`` gives one line for each event under a date-time-pid-level-component header, ``orders``
one message for each order, ``pages`` urls and markup. Truth and parse of the scoring queries are labels by rule: some truths fused, some split.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.functions import cleanup as C
from sawmill.functions import text as T
from sawmill.functions.regexes import compile_format, re2
from sawmill.operators import match, mining, parse, scoring
from sawmill.operators.extract import extract
from sawmill.plans.tables import hot_join, saved, shared_dir
from sawmill.sources.logs import parse_header, read_lines, read_scored, write_csv
from sawmill.sources.presets import COLLECTIONS, SHARED_MASKS
from sawmill.streaming import miner

FLAGSHIP = "template_occurrences"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Rendered lines ---------------------------------------------------------------------------------

HEADER = COLLECTIONS["HDFS"][0]
OPTIONAL_HEADER = r"<Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>"
#: A mask for the props of events; all other masks are the shared ones.
EVENT_MASKS = [r"k\W+\d+"]

_LINE = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || user_id || ' ' || upper(event_type) || ' svc.' || event_type || ': user ' || user_id || ' value ' || value || ' props ' || props"
_RX = re2(r"^(.*?)\s+(.*?)\s+(.*?)\s+(.*?)\s+(.*?):\s+(.*?)$")
_CONTENT = "lower(event_type) || ': user ' || user_id || ' value ' || value || ' props ' || props"
_ORDER = "'order ' || o_orderkey || ' of customer ' || o_custkey || ' status ' || o_orderstatus || ' priority ' || o_orderpriority || ' total ' || o_totalprice"


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, dataset, value): rendered log lines."""
    e = _read(spark, sf_dir, "events")
    content = F.concat(F.lit("user "), "user_id", F.lit(" value "), "value", F.lit(" props "), "props")
    return e.select(F.col("event_id").alias("line_no"), F.concat(F.lit("d"), F.col("user_id") % 4).alias("dataset"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "user_id", F.lit(" "), F.upper("event_type"), F.lit(" svc."), "event_type", F.lit(": "), content).alias("value"))


def event_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, dataset, content): the message of each line with its level before it."""
    h = parse_header(event_lines(spark, sf_dir), HEADER, drop_unmatched=True)
    return h.select("line_no", "dataset", F.concat(F.lower("Level"), F.lit(": "), "Content").alias("content"))


def order_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    text = F.concat(F.lit("order "), "o_orderkey", F.lit(" of customer "), "o_custkey", F.lit(" status "), "o_orderstatus", F.lit(" priority "), "o_orderpriority", F.lit(" total "), "o_totalprice")
    return o.select(F.col("o_orderkey").alias("line_no"), F.concat(F.lit("o"), F.col("o_custkey") % 3).alias("dataset"), text.alias("content"))


def masked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.preprocess(event_contents(spark, sf_dir), "content", EVENT_MASKS, SHARED_MASKS)


def sql_mask(source: str, column: str, patterns: list[str]) -> str:
    for p in patterns:
        source = f"SELECT * REPLACE (CASE WHEN regexp_matches(replace(_m, '<*>', ''), '[a-zA-Z]') THEN _m ELSE {column} END AS {column}) FROM (SELECT *, regexp_replace({column}, {_lit(re2(p))}, '<*>', 'g') AS _m FROM ({source}))"
        source = f"SELECT * EXCLUDE (_m) FROM ({source})"
    return source


def sql_collapse(source: str, column: str) -> str:
    a, b = re2(r"([\w.-]+)?<\*>([\w.-]+)?"), re2(r"<\*>([\s.\-\\/]*<\*>)*")
    source = f"SELECT *, regexp_replace({column}, {_lit(a)}, '<*>', 'g') AS _m FROM ({source})"
    return f"SELECT * EXCLUDE (_m) REPLACE (regexp_replace(CASE WHEN regexp_matches(replace(_m, '<*>', ''), '[a-zA-Z]') THEN _m ELSE {column} END, {_lit(b)}, '<*>', 'g') AS {column}) FROM ({source})"


def sql_preprocess(source: str, column: str, dataset: list[str], shared: list[str]) -> str:
    source = f"SELECT * REPLACE (translate({column}, '<>{{}}', '＜＞｛｝') AS {column}) FROM ({source})"
    return sql_collapse(sql_mask(sql_mask(source, column, dataset), column, shared), column)


_EVENTS = f"SELECT event_id AS line_no, 'd' || (user_id % 4) AS dataset, {_CONTENT} AS content FROM events"
_MASKED = sql_preprocess(_EVENTS, "content", EVENT_MASKS, SHARED_MASKS)

# Headers ----------------------------------------------------------------------------------------


@query(f"SELECT event_id AS line_no, regexp_extract({_LINE}, {_lit(_RX)}, 1) AS Date, regexp_extract({_LINE}, {_lit(_RX)}, 2) AS Time, regexp_extract({_LINE}, {_lit(_RX)}, 3) AS Pid, regexp_extract({_LINE}, {_lit(_RX)}, 4) AS Level, regexp_extract({_LINE}, {_lit(_RX)}, 5) AS Component, regexp_extract({_LINE}, {_lit(_RX)}, 6) AS Content FROM events")
def header_parse(spark, sf_dir):
    return parse_header(event_lines(spark, sf_dir), HEADER).drop("dataset", "value")


_OPT = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' svc' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '[' || user_id || ']' END || ': value ' || value"
_OPT_RX = re2(r"^(.*?)\s+(.*?)\s+(.*?)\s+(.*?)(\[(.*?)\])?:\s+(.*?)$")


@query(f"SELECT event_id AS line_no, regexp_extract({_OPT}, {_lit(_OPT_RX)}, 4) AS Component, nullif(regexp_extract({_OPT}, {_lit(_OPT_RX)}, 6), '') AS PID, regexp_extract({_OPT}, {_lit(_OPT_RX)}, 7) AS Content FROM events")
def header_optional_group(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    pid = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("["), "user_id", F.lit("]")))
    lines = e.select(F.col("event_id").alias("line_no"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.upper("event_type"), F.lit(" svc"), pid, F.lit(": value "), "value").alias("value"))
    return parse_header(lines, OPTIONAL_HEADER).select("line_no", "Component", "PID", "Content")


def _broken(spark, sf_dir):
    return event_lines(spark, sf_dir).withColumn("value", F.when(F.col("line_no") % 7 == 0, F.replace("value", F.lit(": "), F.lit(" "))).otherwise(F.col("value")))


_BROKEN = f"SELECT event_id AS line_no, CASE WHEN event_id % 7 = 0 THEN replace({_LINE}, ': ', ' ') ELSE {_LINE} END AS value FROM events"


@query(f"SELECT line_no, CASE WHEN regexp_matches(value, {_lit(_RX)}) THEN regexp_extract(value, {_lit(_RX)}, 4) END AS Level, CASE WHEN regexp_matches(value, {_lit(_RX)}) THEN regexp_extract(value, {_lit(_RX)}, 6) END AS Content FROM ({_BROKEN})")
def header_unmatched_kept(spark, sf_dir):
    return parse_header(_broken(spark, sf_dir), HEADER).select("line_no", "Level", "Content")


@query(f"SELECT line_no, regexp_extract(value, {_lit(_RX)}, 4) AS Level, regexp_extract(value, {_lit(_RX)}, 6) AS Content FROM ({_BROKEN}) WHERE regexp_matches(value, {_lit(_RX)})")
def header_unmatched_dropped(spark, sf_dir):
    return parse_header(_broken(spark, sf_dir), HEADER, drop_unmatched=True).select("line_no", "Level", "Content")


@query(f"SELECT event_id AS line_no, {_LINE} AS value FROM events WHERE event_id < 100")
def line_limit(spark, sf_dir):
    """The first 100 lines by number: a limit is the feature here."""
    return event_lines(spark, sf_dir).where("line_no < 100").select("line_no", "value")


# Scalar rules -----------------------------------------------------------------------------------


@query("SELECT page_id, translate(html, '<>{}', '＜＞｛｝') AS text FROM pages")
def escape_reserved(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.escape_reserved(F.col("html")).alias("text"))


@query("SELECT page_id, html AS text FROM pages")
def restore_reserved(spark, sf_dir):
    marked = F.concat(T.escape_reserved(F.col("html")), F.lit("{V}"))
    return _read(spark, sf_dir, "pages").select("page_id", T.restore_reserved(marked).alias("text"))


@query(f"SELECT line_no, content FROM ({sql_mask(_EVENTS, 'content', EVENT_MASKS)})")
def mask_dataset(spark, sf_dir):
    return T.mask(event_contents(spark, sf_dir), "content", EVENT_MASKS).select("line_no", "content")


@query(f"SELECT line_no, content FROM ({sql_mask(_EVENTS, 'content', SHARED_MASKS)})")
def mask_shared(spark, sf_dir):
    return T.mask(event_contents(spark, sf_dir), "content", SHARED_MASKS).select("line_no", "content")


_GUARD = "SELECT event_id AS line_no, CASE WHEN event_id % 2 = 0 THEN user_id || ' ' || value ELSE 'at ' || user_id || ' root 0x1F' END AS content FROM events"


@query(f"SELECT line_no, content FROM ({sql_mask(_GUARD, 'content', SHARED_MASKS)})")
def mask_guarded(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.concat("user_id", F.lit(" "), "value")).otherwise(F.concat(F.lit("at "), "user_id", F.lit(" root 0x1F")))
    return T.mask(e.select(F.col("event_id").alias("line_no"), text.alias("content")), "content", SHARED_MASKS)


_WILD = "SELECT event_id AS line_no, CASE event_id % 4 WHEN 0 THEN 'a<*>b-c <*> <*>/<*> end' WHEN 1 THEN '<*>x <*>.<*>' WHEN 2 THEN event_type || ' <*> - <*> ' || user_id ELSE 'no wildcard ' || value END AS content FROM events"


def _wild(spark, sf_dir):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.lit("a<*>b-c <*> <*>/<*> end")).when(k == 1, F.lit("<*>x <*>.<*>")).when(k == 2, F.concat("event_type", F.lit(" <*> - <*> "), "user_id")).otherwise(F.concat(F.lit("no wildcard "), "value"))
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), text.alias("content"))


@query(f"SELECT line_no, content FROM ({sql_collapse(_WILD, 'content')})")
def collapse_wildcard(spark, sf_dir):
    return T.collapse_wildcards(_wild(spark, sf_dir), "content")


@query(f"SELECT line_no, content FROM ({_MASKED})")
def preprocess(spark, sf_dir):
    return masked_events(spark, sf_dir).select("line_no", "content")


@query(f"SELECT line_no, regexp_matches(replace(content, '<*>', ''), '[a-zA-Z]') AS has_word, regexp_matches(content, '[a-zA-Z]') AS has_letter, len(regexp_extract_all(content, {_lit(re2(chr(92) + 'w+'))})) < 2 AS one_word FROM ({_GUARD} UNION ALL SELECT -1 - line_no, content FROM ({_WILD}))")
def word_predicates(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.concat("user_id", F.lit(" "), "value")).otherwise(F.concat(F.lit("at "), "user_id", F.lit(" root 0x1F")))
    rows = e.select(F.col("event_id").alias("line_no"), text.alias("content")).union(_wild(spark, sf_dir).select(-1 - F.col("line_no"), "content"))
    c = F.col("content")
    return rows.select("line_no", T.has_word(c).alias("has_word"), T.has_letter(c).alias("has_letter"), T.one_word(c).alias("one_word"))


def _tokens_sql(pattern: str) -> str:
    return f"SELECT line_no, CAST(pos AS INTEGER) AS pos, ts[pos + 1] AS token, regexp_matches(ts[pos + 1], '[a-zA-Z]') OR ts[pos + 1] = '<*>' AS is_word FROM (SELECT line_no, ts, unnest(range(len(ts))) AS pos FROM (SELECT line_no, regexp_extract_all(content, {_lit('(?s)' + re2(pattern))}) AS ts FROM ({_MASKED})))"


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("line_no", F.posexplode("ts").alias("pos", "token")).withColumn("is_word", T.is_word_token(F.col("token")))


@query(_tokens_sql(T.TOKEN))
def tokenize(spark, sf_dir):
    return _exploded(masked_events(spark, sf_dir).select("line_no", T.tokens(F.col("content")).alias("ts")))


@query(_tokens_sql(T.SIMPLE_TOKEN))
def tokenize_simple(spark, sf_dir):
    return _exploded(masked_events(spark, sf_dir).select("line_no", T.simple_tokens(F.col("content")).alias("ts")))


@query("SELECT doc_id, text, true AS lossless FROM documents")
def tokenize_lossless(spark, sf_dir):
    """Tokens joined again, on texts of several lines and languages."""
    d = _read(spark, sf_dir, "documents")
    again = F.array_join(T.tokens(F.col("text")), "")
    return d.select("doc_id", again.alias("text"), (again == F.col("text")).alias("lossless"))


@query("SELECT page_id, regexp_replace(url || ' <<a b>><<c>> <d> ' || html, '(<<(.*?)>>)+|(<(.*?)>)+', '<*>', 'g') AS text FROM pages")
def normalize_placeholders_whole(spark, sf_dir):
    """The whole of each page."""
    p = _read(spark, sf_dir, "pages")
    return p.select("page_id", T.normalize_placeholders(F.concat("url", F.lit(" <<a b>><<c>> <d> "), "html")).alias("text"))


# Samples and templates --------------------------------------------------------------------------


@query(f"SELECT dataset, content AS sample_text, count(*) AS log_num, min(line_no) AS first_line FROM ({_MASKED}) GROUP BY ALL")
def sample_dedupe(spark, sf_dir):
    return mining.samples(masked_events(spark, sf_dir)).drop("sample_id")


@query(f"SELECT line_no, min(line_no) OVER (PARTITION BY dataset, content) AS first_line FROM ({_MASKED})")
def sample_first_seen(spark, sf_dir):
    rows = masked_events(spark, sf_dir)
    found = mining.samples(rows).select("dataset", F.col("sample_text").alias("content"), "first_line", "log_num")
    return hot_join(rows, saved(found, "samples"), ["dataset", "content"], "log_num").select("line_no", "first_line")


@query(f"SELECT translate(content, '＜＞｛｝', '<>{{}}') AS EventTemplate, count(*) AS Occurrences, min(line_no) AS first_line FROM ({_MASKED}) GROUP BY 1")
def template_occurrences(spark, sf_dir):
    """Lines by event template: the masked text of each line."""
    return match.occurrences(masked_events(spark, sf_dir).withColumn("EventTemplate", T.restore_reserved(F.col("content"))))


@query(f"SELECT dataset, content AS template_text, CAST(sum(log_num) AS BIGINT) AS lines, count(*) AS samples FROM (SELECT dataset, content, user, count(*) AS log_num FROM (SELECT m.*, user_id AS user FROM ({_MASKED}) m JOIN events e ON m.line_no = e.event_id) GROUP BY ALL) GROUP BY ALL")
def template_size(spark, sf_dir):
    rows = masked_events(spark, sf_dir).join(_read(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), "user_id"), "line_no")
    found = rows.groupBy("dataset", "content", "user_id").agg(F.count("*").alias("log_num"))
    return found.groupBy("dataset", F.col("content").alias("template_text")).agg(F.sum("log_num").alias("lines"), F.count("*").alias("samples"))


# Fixed templates for the matching queries, in their order: the first that matches counts.
TEMPLATES = [
    "click: user <*> value <*> props ＜*＞", "error: user <*>", "error: <*>", "view: user 1<*> value <*>", "view: user <*> value <*>", "<*>: user <*> value 1<*>",
    "purchase: {V}user <*> value <*>", "signup: user <*> {V}value <*> props <*>", "<*> value <*>", "purchase: user <*>", "view: <*>",
]


def _template_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(TEMPLATES)], "template_id long, template_text string, ord int")


def _pattern_sql(template: str) -> str:
    from sawmill.functions.regexes import template_pattern

    return template_pattern(template, "re2")[len(r"\A(?:") : -len(r")\z")]


_RULES = "(VALUES " + ", ".join(f"({i}, {_lit(t)}, {_lit(_pattern_sql(t))}, {_lit(_pattern_sql(t.replace('{V}', '')))})" for i, t in enumerate(TEMPLATES)) + ") r(template_id, template_text, one, two)"


def _matched(spark, sf_dir):
    return match.with_first_match(event_contents(spark, sf_dir).select("line_no", "content"), "content", _template_rows(spark))


_HITS = f"SELECT line_no, template_id, 1 AS pass FROM ({_EVENTS}) JOIN {_RULES} ON regexp_full_match(content, one) UNION ALL SELECT line_no, template_id, 2 FROM ({_EVENTS}) JOIN {_RULES} ON regexp_full_match(content, two) AND template_text LIKE '%{{V}}%'"


@query(f"SELECT line_no, CAST(arg_min(template_id, pass * 1000 + template_id) AS BIGINT) AS template_id FROM ({_HITS}) GROUP BY line_no")
def first_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("line_no", "template_id")


@query(f"SELECT line_no, CAST(min(pass) AS INTEGER) AS pass FROM ({_HITS}) GROUP BY line_no")
def first_match_pass2(spark, sf_dir):
    return _matched(spark, sf_dir).select("line_no", "pass")


@query(f"SELECT CAST(a.template_id AS BIGINT) AS coverer_id, CAST(b.template_id AS BIGINT) AS covered_id FROM {_RULES.replace(' r(', ' a(')} JOIN {_RULES.replace(' r(', ' b(')} ON a.template_text <> b.template_text AND regexp_full_match(b.template_text, a.one)")
def containment_pairs(spark, sf_dir):
    return match.containment(_template_rows(spark))


@query(f"SELECT line_no, CAST(template_id AS BIGINT) AS EventId, translate(replace(template_text, '{{V}}', ''), '＜＞｛｝', '<>{{}}') AS EventTemplate FROM (SELECT line_no, arg_min(template_id, pass * 1000 + template_id) AS template_id FROM ({_HITS}) GROUP BY line_no) JOIN {_RULES} USING (template_id)")
def structured_log(spark, sf_dir):
    """Lines by way of their samples to the templates that the samples have in the end."""
    rows = event_contents(spark, sf_dir)
    rows = saved(rows.select("line_no", "content").withColumn("sample_id", F.xxhash64("content")), "lines")
    texts = rows.groupBy("sample_id", "content").agg(F.count("*").alias("log_num"))
    found = match.with_first_match(texts, "content", _template_rows(spark)).select("sample_id", "template_id", "log_num")
    return match.structured(rows.select("line_no", "sample_id"), found, _template_rows(spark)).where("EventId is not null").select("line_no", "EventId", "EventTemplate")


@query(f"SELECT dataset, CAST(r.template_id AS BIGINT) AS template_id, bool_and(regexp_full_match(content, one)) AS every FROM ({_EVENTS}), {_RULES} GROUP BY ALL")
def match_all(spark, sf_dir):
    """Whether a template matches every text of a dataset."""
    texts = event_contents(spark, sf_dir).select("dataset", F.col("content").alias("text"))
    rules = texts.select("dataset").distinct().withColumn("rules", F.array(*(F.struct(F.lit(i).cast("long").alias("template_id"), F.lit(t).alias("template_text")) for i, t in enumerate(TEMPLATES)))).select("dataset", F.inline("rules"))
    return match.match_all(texts, rules, ["dataset"])


@query(f"SELECT CAST(template_id AS BIGINT) AS template_id, count(DISTINCT content) AS samples, min(content) AS first_text FROM (SELECT content, template_id FROM (SELECT content, arg_min(template_id, pass * 1000 + template_id) AS template_id FROM (SELECT content, template_id, 1 AS pass FROM ({_EVENTS}) JOIN {_RULES} ON regexp_full_match(content, one) UNION ALL SELECT content, template_id, 2 FROM ({_EVENTS}) JOIN {_RULES} ON regexp_full_match(content, two) AND template_text LIKE '%{{V}}%') GROUP BY content)) GROUP BY 1")
def samples_by_template(spark, sf_dir):
    found = match.first_match(event_contents(spark, sf_dir).select(F.col("content").alias("text")), _template_rows(spark))
    return found.groupBy("template_id").agg(F.count("*").alias("samples"), F.min("text").alias("first_text"))


# Files ------------------------------------------------------------------------------------------


def line_files(spark, sf_dir) -> str:
    """The rendered lines as text files in the shared folder, one for each dataset, in the order of event_id."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows = event_lines(spark, sf_dir).repartition("dataset").sortWithinPartitions("dataset", "line_no").select("dataset", "value")
    rows.write.partitionBy("dataset").text(path)
    return path


def _named(rows: DataFrame, column: str) -> DataFrame:
    """The dataset in place of the path of its file."""
    return rows.withColumn(column, F.regexp_extract(column, "dataset=([^/]+)/", 1))


_NUMBERED = f"SELECT 'd' || (user_id % 4) AS dataset, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS line_no, {_LINE} AS value, {_CONTENT} AS levelled, event_id FROM events"


@query(f"SELECT dataset, line_no, value FROM ({_NUMBERED})")
def file_lines(spark, sf_dir):
    return _named(read_lines(spark, line_files(spark, sf_dir)), "path").withColumnRenamed("path", "dataset")


@query(f"SELECT dataset, line_no, value FROM ({_NUMBERED}) WHERE line_no <= 50")
def file_line_limit(spark, sf_dir):
    """The first 50 lines of each file: a limit is the feature here."""
    return _named(read_lines(spark, line_files(spark, sf_dir), 50), "path").withColumnRenamed("path", "dataset")


_FILE_LOG = sql_preprocess(f"SELECT dataset, line_no AS LineId, regexp_extract(value, {_lit(_RX)}, 4) AS Level, regexp_extract(value, {_lit(_RX)}, 6) AS content FROM ({_NUMBERED})", "content", EVENT_MASKS, SHARED_MASKS)


@query(f"SELECT dataset, CAST(LineId AS BIGINT) AS LineId, Level, translate(content, '＜＞｛｝', '<>{{}}') AS EventTemplate FROM ({_FILE_LOG})")
def file_structured(spark, sf_dir):
    """From text files to the structured log; each masked text is its template."""
    log, _ = parse.parse_files(spark, line_files(spark, sf_dir), HEADER, EVENT_MASKS, merge=False, split=False)
    return _named(log, "dataset").select("dataset", "LineId", "Level", "EventTemplate")


@query(f"SELECT dataset, translate(content, '＜＞｛｝', '<>{{}}') AS EventTemplate, count(*) AS Occurrences, CAST(min(LineId) AS BIGINT) AS first_line FROM ({_FILE_LOG}) GROUP BY ALL")
def file_templates(spark, sf_dir):
    _, found = parse.parse_files(spark, line_files(spark, sf_dir), HEADER, EVENT_MASKS, merge=False, split=False)
    return _named(found, "dataset")


@query()
def file_mined(spark, sf_dir):
    """From text files to mined templates, written as CSV and read again."""
    path = f"{shared_dir(spark)}/parse-{uuid.uuid4().hex}"
    log, found = parse.parse_files(spark, line_files(spark, sf_dir), HEADER)
    parse.write_parse(log, found, f"{path}/structured", f"{path}/templates")
    return _named(read_scored(spark, f"{path}/templates"), "dataset")


# Presets ----------------------------------------------------------------------------------------


def _preset_pieces(log_format: str) -> list[tuple[str, str]]:
    """A header format as pieces: (text, ...), (field, ...) and the optional part (open, close), with its escapes undone."""
    out, i = [], 0
    while i < len(log_format):
        c = log_format[i]
        if c == "<":
            close = log_format.index(">", i)
            out.append(("field", log_format[i + 1 : close]))
            i = close + 1
        elif c == "\\":
            out.append(("text", log_format[i + 1]))
            i += 2
        elif c in "()?":
            out += [("open", "")] if c == "(" else [("close", "")] if c == ")" else []
            i += 1
        else:
            out.append(("text", c))
            i += 1
    return out


def _preset_line(name: str, log_format: str) -> str:
    """SQL of a line in this format: fields are their name and a number of the event, an optional part is there for even users, and content is the event's own."""
    values = {"Content": "'user ' || user_id || ' did ' || event_type || ' on ' || value"}
    out = ["''"]
    for kind, text in _preset_pieces(log_format):
        if kind == "open":
            out.append("CASE WHEN user_id % 2 = 0 THEN ''")
        elif kind == "close":
            out[-1] += " ELSE '' END"
        else:
            piece = _lit(text) if kind == "text" else values.get(text, f"'{text.lower()}' || (event_id % 60)")
            if out[-1].startswith("CASE") and not out[-1].endswith("END"):
                out[-1] += f" || {piece}"
            else:
                out.append(piece)
    return " || ".join(f"({x})" for x in out)


def _one_group(pattern: str, group: int) -> str:
    """A pattern in which this group alone is taken, as DuckDB takes nine at most."""
    parts = re.split(r"(?<!\\)\((?!\?)", pattern)
    return parts[0] + "".join(("(" if k == group else "(?:") + part for k, part in enumerate(parts[1:], 1))


def _preset_sql() -> str:
    parts = []
    for name, (log_format, _) in COLLECTIONS.items():
        h = compile_format(log_format)
        got = [f"regexp_extract(line, {_lit(re2(_one_group(h.pattern, g)))}, 1)" for g in h.groups]
        fields = ", ".join(f"coalesce(nullif({x}, ''), '-')" if f in h.optional else x for f, x in zip(h.fields, got))
        parts.append(f"SELECT {_lit(name)} AS collection, event_id AS line_no, concat_ws('|', {fields}) AS fields FROM (SELECT event_id, {_preset_line(name, log_format)} AS line FROM events)")
    return " UNION ALL ".join(parts)


@query(_preset_sql())
def preset_headers(spark, sf_dir):
    """Lines in the format of each of the 16 collections, and the fields that its preset finds in them."""
    found = None
    for name, (log_format, _) in COLLECTIONS.items():
        h = compile_format(log_format)
        lines = _read(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.expr(_preset_line(name, log_format).replace("\\", "\\\\")).alias("value"))
        rows = parse_header(lines, h, drop_unmatched=True)
        rows = rows.select(F.lit(name).alias("collection"), "line_no", F.concat_ws("|", *(F.coalesce(F.col(f), F.lit("-")) for f in h.fields)).alias("fields"))
        found = rows if found is None else found.unionByName(rows)
    return found


# Cleanup ----------------------------------------------------------------------------------------

_RAW_PARTS = ["'open /var/log/' || event_type || '  by root, TRUE '", "'a <*>.<*>.<*> b <*><*><*>'", "'##<*>## and #<*>#<*>#'", "'x <*>:<*>:<*> y=/etc/' || user_id || '/z'", "' null|admin@' || event_type || ' groot x/null root.a'", "'p=/a//b /c/ (/d) user <*>.<*>:<*><*>'"]
_RAW = "SELECT event_id AS id, CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_RAW_PARTS)) + " END AS t FROM events"


def raw_templates(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    parts = [
        F.concat(F.lit("open /var/log/"), "event_type", F.lit("  by root, TRUE ")), F.lit("a <*>.<*>.<*> b <*><*><*>"), F.lit("##<*>## and #<*>#<*>#"), F.concat(F.lit("x <*>:<*>:<*> y=/etc/"), "user_id", F.lit("/z")),
        F.concat(F.lit(" null|admin@"), "event_type", F.lit(" groot x/null root.a")), F.lit("p=/a//b /c/ (/d) user <*>.<*>:<*><*>"),
    ]
    return e.select(F.col("event_id").alias("id"), F.coalesce(*(F.when(F.col("event_id") % 6 == i, p) for i, p in enumerate(parts))).alias("t"))


def _piece_sql(t: str, delimiters: str, test: str) -> str:
    d = re2(f"[{delimiters}]|[^{delimiters}]+")
    return f"array_to_string(list_transform(regexp_extract_all({t}, {_lit(d)}), lambda x: CASE WHEN {test} THEN '<*>' ELSE x END), '')"


_S = re2(r"\s+")
_SPACE_SQL = f"regexp_replace(regexp_replace(regexp_replace(t, {_lit('^' + _S)}, ''), {_lit(_S + '$')}, ''), {_lit(_S)}, ' ', 'g')"
_PATH_TEST = "regexp_matches(x, '^(/[^/]+)+$')"


def _constant_test(user=()) -> str:
    return "lower(x) IN (" + ", ".join(_lit(s) for s in sorted({*C.CONSTANTS, *user})) + ")"


def _hash_sql(t: str) -> str:
    for _ in range(6):
        t = f"replace({t}, '#<*>#', '<*>')"
    return t


def _clean_sql(source: str, user=()) -> str:
    steps = [_SPACE_SQL, _piece_sql("t", C.PATH_DELIMITERS, _PATH_TEST), _piece_sql("t", C.TOKEN_DELIMITERS, _constant_test(user)), r"regexp_replace(t, '<\*>(\.<\*>)+', '<*>', 'g')", r"regexp_replace(t, '(<\*>){2,}', '<*>', 'g')", _hash_sql("t"), r"regexp_replace(t, '<\*>(:<\*>)+', '<*>', 'g')"]
    for s in steps:
        source = f"SELECT * REPLACE ({s} AS t) FROM ({source})"
    return source


def _rule(name: str, sql: str, rule) -> None:
    def run(spark, sf_dir):
        return raw_templates(spark, sf_dir).select("id", rule(F.col("t")).alias("t"))

    run.__name__ = name
    query(f"SELECT id, {sql} AS t FROM ({_RAW})")(run)


_rule("cleanup_space", _SPACE_SQL, C.spaces)
_rule("cleanup_path", _piece_sql("t", C.PATH_DELIMITERS, _PATH_TEST), C.paths)
_rule("cleanup_boolean", _piece_sql("t", C.TOKEN_DELIMITERS, _constant_test()), C.constants)
_rule("cleanup_user_strings", _piece_sql("t", C.TOKEN_DELIMITERS, _constant_test(("click", "groot"))), lambda c: C.constants(c, ("click", "groot")))
_rule("cleanup_dotted", r"regexp_replace(t, '<\*>(\.<\*>)+', '<*>', 'g')", C.dotted)
_rule("cleanup_consecutive", r"regexp_replace(t, '(<\*>){2,}', '<*>', 'g')", C.consecutive)
_rule("cleanup_hash", _hash_sql("t"), C.hashed)
_rule("cleanup_colon", r"regexp_replace(t, '<\*>(:<\*>)+', '<*>', 'g')", C.colons)


@query(f"SELECT id, t AS EventTemplate FROM ({_clean_sql(_RAW)})")
def cleanup_full(spark, sf_dir):
    return C.post_process(raw_templates(spark, sf_dir).withColumnRenamed("t", "EventTemplate"))


@query(f"SELECT t AS EventTemplate, count(*) AS Occurrences, min(id) AS first_line FROM ({_clean_sql(_RAW)}) GROUP BY 1")
def cleanup_counts(spark, sf_dir):
    return match.occurrences(C.post_process(raw_templates(spark, sf_dir).withColumnsRenamed({"t": "EventTemplate", "id": "line_no"})))


@query(f"SELECT CAST(id AS VARCHAR) AS id, t AS EventTemplate FROM ({_clean_sql(_RAW)})")
def adjusted_files(spark, sf_dir):
    """A parse as CSV files, read, cleaned, written and read again."""
    path = f"{shared_dir(spark)}/adjusted-{uuid.uuid4().hex}"
    write_csv(raw_templates(spark, sf_dir).withColumnRenamed("t", "EventTemplate"), f"{path}/structured")
    write_csv(C.post_process(read_scored(spark, f"{path}/structured")), f"{path}/adjusted")
    return read_scored(spark, f"{path}/adjusted")


@query(f"SELECT url, t AS template FROM ({_clean_sql('SELECT url, replace(replace(url, chr(63), chr(32)), chr(47) || chr(47), chr(32) || chr(47)) AS t FROM pages')})")
def cleanup_urls(spark, sf_dir):
    p = _read(spark, sf_dir, "pages").select("url", F.replace(F.replace("url", F.lit("?"), F.lit(" ")), F.lit("//"), F.lit(" /")).alias("template"))
    return C.cleaned(p, "template")


# Scoring ----------------------------------------------------------------------------------------

_TRUTH = "CASE WHEN event_id % 500 = 7 THEN 'rare ' || event_id || ' <*>' ELSE event_type || ' by <*>' END"
_PARSED = "CASE WHEN event_id % 1000 = 7 THEN 'rare ' || event_id || ' <*>' WHEN event_type IN ('click', 'view') THEN 'click by <*>' WHEN event_type = 'error' AND value > 10 THEN 'error by user <*>' WHEN event_type = 'signup' AND user_id = 3 THEN NULL WHEN event_type = 'signup' THEN 'signup: by <*>' ELSE event_type || ' by <*>' END"
_SCORED = f"SELECT 'd' || (user_id % 4) AS dataset, {_TRUTH} AS truth, coalesce({_PARSED}, '') AS parsed FROM events"
_PAIRS = f"SELECT dataset, truth, parsed, count(*) AS n FROM ({_SCORED}) GROUP BY ALL"


def _sized_sql(pairs: str) -> str:
    return f"SELECT *, sum(n) OVER (PARTITION BY dataset, truth) AS tn, count(*) OVER (PARTITION BY dataset, truth) AS tk, sum(n) OVER (PARTITION BY dataset, parsed) AS pn, count(*) OVER (PARTITION BY dataset, parsed) AS pk FROM ({pairs})"


_SIZED = _sized_sql(_PAIRS)
ONLY = ["click by <*>", "error by <*>", "purchase by <*>"]


def scored_lines(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("d"), F.col("user_id") % 4).alias("dataset"), F.expr(_TRUTH.replace("||", "||")).alias("truth"), F.expr(_PARSED).alias("parsed"))


def _pairs(spark, sf_dir):
    return scoring.pair_table(scored_lines(spark, sf_dir))


def _scores_sql(only: list[str] | None = None, pairs: str = _PAIRS) -> str:
    inside = "true" if only is None else "truth IN (" + ", ".join(map(_lit, only)) + ")"
    ground = "count(DISTINCT truth)" if only is None else str(len(only))
    parsed_inside = inside.replace("truth", "parsed")
    words = lambda c: f"regexp_extract_all({c}, {_lit(re2(chr(92) + 'w+'))})"
    base = f"""SELECT dataset, CAST(sum(n) AS DOUBLE) AS lines, CAST(sum(n) FILTER ({inside}) AS DOUBLE) AS inside_n, CAST(coalesce(sum(n) FILTER ({inside} AND tk = 1 AND pn = tn), 0) AS DOUBLE) AS gl, CAST(count(*) FILTER ({inside} AND tk = 1 AND pn = tn) AS DOUBLE) AS gt,
    count(DISTINCT CASE WHEN {inside} THEN parsed END) AS tool, {ground} AS ground, CAST(coalesce(sum(n) FILTER ({inside} AND truth = parsed), 0) AS DOUBLE) AS same, CAST(count(*) FILTER (truth = parsed AND pk = 1 AND {parsed_inside}) AS DOUBLE) AS ex,
    CAST(sum(n * levenshtein(truth, parsed)) AS DOUBLE) AS edits, CAST(coalesce(sum(n) FILTER (tn = 1), 0) AS DOUBLE) AS lone, CAST(coalesce(sum(n) FILTER (tn = 1 AND truth = parsed), 0) AS DOUBLE) AS lone_same,
    CAST(coalesce(sum(n) FILTER ({words('truth')} = {words('parsed')}), 0) AS DOUBLE) AS sw, CAST(sum(n * (n - 1) / 2) AS DOUBLE) AS np FROM ({_sized_sql(pairs)}) GROUP BY dataset"""
    side = lambda k: f"(SELECT dataset, CAST(sum(m * (m - 1) / 2) AS DOUBLE) AS x FROM (SELECT dataset, sum(n) AS m FROM ({pairs}) GROUP BY dataset, {k}) GROUP BY dataset)"
    f = lambda a, b: f"CASE WHEN {a} <> 0 OR {b} <> 0 THEN 2 * ({a} * {b}) / ({a} + {b}) ELSE 0.0 END"
    return f"""WITH b AS ({base}), r AS (SELECT b.*, gt / tool AS PGA, gt / ground AS RGA, ex / tool AS PTA, ex / ground AS RTA, CASE WHEN p.x <> 0 THEN np / p.x ELSE 0.0 END AS pp, CASE WHEN t.x <> 0 THEN np / t.x ELSE 0.0 END AS pr FROM b JOIN {side('parsed')} p USING (dataset) JOIN {side('truth')} t USING (dataset))
    SELECT dataset, gl / inside_n AS GA, {f('PGA', 'RGA')} AS FGA, same / inside_n AS PA, PTA, RTA, {f('PTA', 'RTA')} AS FTA, edits / lines AS ED, CASE WHEN lone > 0 THEN lone_same / lone ELSE 0.0 END AS UP, sw / lines AS WLA, pp AS pair_precision, pr AS pair_recall, {f('pp', 'pr')} AS pair_f1, CAST(tool AS BIGINT) AS tool_templates, CAST(ground AS BIGINT) AS ground_templates FROM r"""


def _metric(name: str, columns: list[str], only: list[str] | None = None) -> None:
    def run(spark, sf_dir):
        return scoring.scores(_pairs(spark, sf_dir), only).select("dataset", *columns)

    run.__name__ = name
    query(f"SELECT dataset, {', '.join(columns)} FROM ({_scores_sql(only)})")(run)


_metric("metric_ga", ["GA"])
_metric("metric_fga", ["GA", "FGA"])
_metric("metric_pa", ["PA"])
_metric("metric_fta", ["PTA", "RTA", "FTA", "tool_templates", "ground_templates"])
_metric("metric_ed", ["ED"])
_metric("metric_up", ["UP"])
_metric("metric_wla", ["WLA"])
_metric("metric_pairs", ["pair_precision", "pair_recall", "pair_f1"])
_metric("metric_row", ["GA", "PA", "ED", "PTA", "RTA", "FTA", "FGA", "UP", "tool_templates", "ground_templates"])
_metric("metric_legacy", ["pair_precision", "pair_recall", "pair_f1", "PA", "ED", "UP", "WLA"])
_metric("metric_filtered", ["GA", "FGA", "PA", "PTA", "RTA", "FTA"], ONLY)


@query(f"SELECT dataset, CAST(coalesce(sum(n) FILTER (pk = 1 AND tn = pn), 0) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS GA FROM ({_SIZED}) GROUP BY dataset")
def metric_ga_parsed(spark, sf_dir):
    """Grouping accuracy from the side of the parse: the same numbers as metric_ga."""
    return scoring.grouping_from_parsed(_pairs(spark, sf_dir))


_RAW_PARSE = f"SELECT 'd' || (user_id % 4) AS dataset, {_TRUTH} AS truth, coalesce(replace({_PARSED}, '<*>', ' <*>.<*>  '), 'nan') AS t FROM events WHERE event_id % 97 <> 0"
_CLEAN_PAIRS = f"SELECT dataset, truth, t AS parsed, count(*) AS n FROM ({_clean_sql(_RAW_PARSE)}) GROUP BY ALL"


@query(f"SELECT dataset, GA, PA, ED, PTA, RTA, FTA, FGA, UP, tool_templates, ground_templates FROM ({_scores_sql(None, _CLEAN_PAIRS)})")
def evaluate_parse(spark, sf_dir):
    """The scoring driver: a parse that needs cleanup and lacks lines, against the truth."""
    e = _read(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.col("user_id") % 4).alias("dataset"), F.col("event_id").alias("LineId"), F.expr(_TRUTH).alias("truth"), F.expr(_PARSED).alias("parsed"))
    truth = e.select("dataset", "LineId", F.col("truth").alias("EventTemplate"))
    parsed = e.where("LineId % 97 <> 0").select("dataset", "LineId", F.replace("parsed", F.lit("<*>"), F.lit(" <*>.<*>  ")).alias("EventTemplate"))
    return scoring.evaluate(truth, parsed).select("dataset", "GA", "PA", "ED", "PTA", "RTA", "FTA", "FGA", "UP", "tool_templates", "ground_templates")


@query(ORACLE_SQL["evaluate_parse"])
def evaluate_not_null(spark, sf_dir):
    """As evaluate_parse, but the lines that lack a template are there, without one, and are left out on both sides."""
    e = _read(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.col("user_id") % 4).alias("dataset"), F.col("event_id").alias("LineId"), F.expr(_TRUTH).alias("truth"), F.expr(f"coalesce({_PARSED}, 'nan')").alias("parsed"))
    truth = e.select("dataset", "LineId", F.col("truth").alias("EventTemplate"))
    parsed = e.select("dataset", "LineId", F.when(F.col("LineId") % 97 != 0, F.replace("parsed", F.lit("<*>"), F.lit(" <*>.<*>  "))).alias("EventTemplate"))
    return scoring.evaluate(truth, parsed, parsed_only=True).select("dataset", "GA", "PA", "ED", "PTA", "RTA", "FTA", "FGA", "UP", "tool_templates", "ground_templates")


def _reports(spark, sf_dir, name):
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    scoring.write_reports(_pairs(spark, sf_dir), path)
    return read_scored(spark, f"{path}/{name}", fill=True)


@query(f"SELECT dataset, 'split' AS kind, parsed AS anchor, truth AS other, CAST(n AS VARCHAR) AS n FROM ({_SIZED}) WHERE pk <> 1 UNION ALL SELECT dataset, 'merge', truth, parsed, CAST(n AS VARCHAR) FROM ({_SIZED}) WHERE tk <> 1")
def report_grouping_errors(spark, sf_dir):
    """Splits and merges, written as CSV and read again."""
    return _reports(spark, sf_dir, "grouping_errors")


@query(f"SELECT dataset, truth, parsed, CAST(n AS VARCHAR) AS n FROM ({_SIZED}) x WHERE tk > 1 OR NOT EXISTS (SELECT 1 FROM ({_PAIRS}) y WHERE y.dataset = x.dataset AND y.truth = x.truth AND y.parsed = x.truth)")
def report_parse_errors(spark, sf_dir):
    """Wrong parses, written as CSV and read again."""
    return _reports(spark, sf_dir, "parse_errors")


@query(f"SELECT dataset, parsed, truth, n FROM ({_SIZED}) WHERE pk <> 1")
def error_split(spark, sf_dir):
    return scoring.split_errors(_pairs(spark, sf_dir))


@query(f"SELECT dataset, truth, parsed, n FROM ({_SIZED}) WHERE tk <> 1")
def error_merge(spark, sf_dir):
    return scoring.merge_errors(_pairs(spark, sf_dir))


@query(f"SELECT dataset, truth, parsed, n FROM ({_SIZED}) x WHERE tk > 1 OR NOT EXISTS (SELECT 1 FROM ({_PAIRS}) y WHERE y.dataset = x.dataset AND y.truth = x.truth AND y.parsed = x.truth)")
def error_pa(spark, sf_dir):
    return scoring.parse_errors(_pairs(spark, sf_dir))


# Mining -----------------------------------------------------------------------------------------


def mining_lines(spark, sf_dir):
    """Whole messages of events and orders. Only addresses and decimals are masked, so that samples vary."""
    light = [r"(\d+\.){3}\d+", r"\d+\.\d+"]
    rows = event_contents(spark, sf_dir).unionByName(order_contents(spark, sf_dir))
    return T.preprocess(rows, "content", [], light)


@query()
def lcs_distance_pairs(spark, sf_dir):
    """Links of samples within the distance: all of them, in one row for all samples of two shapes, or of one, where that holds for all, and one by one elsewhere.

    All pairs of samples as rows would grow with the square of a shape's samples.
    """
    found = saved(mining.samples(mining_lines(spark, sf_dir)), "samples")
    return mining.distance_links(found)


@query()
def similar_clusters(spark, sf_dir):
    return mining.clusters(saved(mining.samples(mining_lines(spark, sf_dir)), "samples")).select("dataset", "sample_id", "cluster", "log_num")


@query()
def lcs_blocks(spark, sf_dir):
    """The common runs of each cluster."""
    return mining.merged(saved(mining.clusters(saved(mining.samples(mining_lines(spark, sf_dir)), "samples")), "clusters"))


#: What parts are called and what type they are of; and one message for each kind and type of parts.
_PART, _KIND = "p_name || ' of type ' || p_type", "'parts of type ' || p_type || ' described as ' || split_part(p_name, ' ', 1) || ' are kept in the same store'"


def part_texts(spark, sf_dir, text):
    """Distinct texts of parts as samples."""
    rows = _read(spark, sf_dir, "part").select(F.lit("parts").alias("dataset"), F.expr(text).alias("sample_text"))
    rows = rows.groupBy("dataset", "sample_text").agg(F.count("*").alias("log_num"))
    return saved(rows.withColumn("sample_id", F.xxhash64("dataset", "sample_text")), "parts")


#: Templates over the descriptions of parts: the kind, what it is, or both left open; ord follows the text.
_OPEN = f"SELECT DISTINCT unnest([p || t, '<*> ' || split_part(p, ' ', 2) || t, split_part(p, ' ', 1) || ' <*>' || t, '<*>' || t]) AS template_text FROM (SELECT p_name AS p, ' of type ' || p_type AS t FROM part)"
_PATTERN = "regexp_replace(template_text, '<\\*> *', '.*?', 'g')"


def part_templates(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.col("p_name").alias("p"), F.concat(F.lit(" of type "), "p_type").alias("t"))
    first, second = F.split_part("p", F.lit(" "), F.lit(1)), F.split_part("p", F.lit(" "), F.lit(2))
    texts = F.array(F.concat("p", "t"), F.concat(F.lit("<*> "), second, "t"), F.concat(first, F.lit(" <*>"), "t"), F.concat(F.lit("<*>"), "t"))
    rows = rows.select(F.explode(texts).alias("template_text")).distinct()
    return saved(rows.withColumn("template_id", F.xxhash64("template_text")).withColumn("ord", F.col("template_text")), "templates")


@query(f"WITH o AS ({_OPEN}), r AS (SELECT template_text, {_PATTERN} AS pattern FROM o WHERE contains(template_text, '<*>')) SELECT r.template_text AS coverer, o.template_text AS covered FROM r JOIN o ON r.template_text <> o.template_text AND regexp_full_match(o.template_text, r.pattern)")
def part_containment(spark, sf_dir):
    """Templates over parts that cover others, by the index on rare words."""
    rows = part_templates(spark, sf_dir)
    names = rows.select("template_id", "template_text")
    found = match.containment(rows).join(names.withColumnsRenamed({"template_id": "coverer_id", "template_text": "coverer"}), "coverer_id")
    return found.join(names.withColumnsRenamed({"template_id": "covered_id", "template_text": "covered"}), "covered_id").select("coverer", "covered")


@query(f"WITH r AS (SELECT template_text, {_PATTERN} AS pattern FROM ({_OPEN}) WHERE contains(template_text, '<*>')), p AS (SELECT p_partkey, {_PART} AS t FROM part), m AS (SELECT t, min(template_text) AS template_text FROM (SELECT DISTINCT t FROM p) JOIN r ON regexp_full_match(t, pattern) GROUP BY t) SELECT p_partkey, template_text FROM p JOIN m USING (t)")
def part_first_match(spark, sf_dir):
    """The first template, by its text, that matches each part's description."""
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.expr(_PART).alias("text"))
    names = part_templates(spark, sf_dir).where(F.contains("template_text", F.lit("<*>")))
    found = match.first_match(rows, names).join(names, "template_id").select("text", "template_text")
    return hot_join(rows, saved(rows.groupBy("text").agg(F.count("*").alias("n")).join(found, "text"), "matched"), "text").select("p_partkey", "template_text")


def _named_pairs(rows, found, value):
    names = found.select("sample_id", "sample_text")
    rows = rows.join(names.withColumnsRenamed({"sample_id": "a", "sample_text": "x"}), "a").join(names.withColumnsRenamed({"sample_id": "b", "sample_text": "y"}), "b")
    return rows.select(F.least("x", "y").alias("first_text"), F.greatest("x", "y").alias("second_text"), F.round(value, 6).alias(value))


# The common subsequence in SQL: one row of the table for each step, in each cell the length times 1,000 and the number of words.
_TOKENS = f"regexp_extract_all(t, {_lit('(?s)' + re2(T.TOKEN))})"
_DISTANCES = f"""
p AS (SELECT DISTINCT text AS t FROM texts),
k AS (SELECT t, {_TOKENS} AS w, len(list_filter({_TOKENS}, lambda x: regexp_matches(x, '[a-zA-Z]') OR x = '<*>')) AS n FROM p),
c AS (
  SELECT a.t AS x, b.t AS y, a.w AS aw, b.w AS bw, greatest(a.n, b.n) AS most, 0 AS i, list_transform(range(len(b.w) + 1), lambda j: CAST(0 AS BIGINT)) AS line FROM k a JOIN k b ON a.t < b.t
  UNION ALL
  SELECT x, y, aw, bw, most, i + 1,
         list_reduce(list_transform(range(1, len(bw) + 1), lambda j: [j]), lambda acc, e: list_append(acc, CASE WHEN bw[e[1]] = aw[i + 1] THEN line[e[1]] + 1000 + CAST(regexp_matches(aw[i + 1], '[a-zA-Z]') OR aw[i + 1] = '<*>' AS BIGINT)
           WHEN line[e[1] + 1] // 1000 >= acc[e[1]] // 1000 THEN line[e[1] + 1] ELSE acc[e[1]] END), [CAST(0 AS BIGINT)])
  FROM c WHERE i < len(aw)),
d AS (SELECT x, y, 1 - (line[len(line)] % 1000) / CAST(most AS DOUBLE) AS distance FROM c WHERE i = len(aw) AND most > 0)
"""
_ROWS = f"""
{_DISTANCES},
m AS (SELECT x, y, CAST(CAST(distance AS FLOAT) AS DOUBLE) AS d FROM d UNION ALL SELECT y, x, CAST(CAST(distance AS FLOAT) AS DOUBLE) FROM d UNION ALL SELECT t, t, 0 FROM p),
r AS (SELECT u.x, v.x AS y, sqrt(sum((u.d - v.d) * (u.d - v.d))) AS row_distance FROM m u JOIN m v ON u.y = v.y AND u.x < v.x GROUP BY u.x, v.x HAVING sqrt(sum((u.d - v.d) * (u.d - v.d))) <= 0.3)
"""


@query(f"WITH RECURSIVE texts AS (SELECT {_PART} AS text FROM part), {_DISTANCES} SELECT x AS first_text, y AS second_text, round(distance, 6) AS distance FROM d WHERE distance <= 0.3")
def part_distance_pairs(spark, sf_dir):
    """Pairs of part descriptions within the distance, by the join on rare words."""
    found = part_texts(spark, sf_dir, _PART)
    return _named_pairs(mining.distance_pairs(found), found, "distance")


@query(f"WITH RECURSIVE texts AS (SELECT {_KIND} AS text FROM part), {_ROWS} SELECT x AS first_text, y AS second_text, round(row_distance, 6) AS row_distance FROM r")
def part_row_distances(spark, sf_dir):
    """Pairs of messages about parts whose rows of the distance matrix are near."""
    found = part_texts(spark, sf_dir, _KIND)
    return _named_pairs(mining.row_pairs(found), found, "row_distance")


@query(f"WITH RECURSIVE texts AS (SELECT {_KIND} AS text FROM part), {_ROWS}, g AS (SELECT x, y FROM r UNION ALL SELECT y, x FROM r), s AS (SELECT t AS node, t AS root FROM p UNION SELECT s.node, g.y FROM s JOIN g ON s.root = g.x) SELECT node AS text, min(root) AS cluster FROM s GROUP BY node")
def part_row_clusters(spark, sf_dir):
    """Messages about parts with the first text of their cluster of near rows."""
    found = mining.row_clusters(part_texts(spark, sf_dir, _KIND))
    first = found.groupBy("cluster").agg(F.min("sample_text").alias("name"))
    return found.join(first, "cluster").select(F.col("sample_text").alias("text"), F.col("name").alias("cluster"))


def _mined(spark, sf_dir, **options):
    found, names = mining.mine(mining_lines(spark, sf_dir), **options)
    sizes = found.groupBy("template_id").agg(F.sum("log_num").alias("Occurrences"), F.count("*").alias("samples"))
    return names.join(sizes, "template_id").select("dataset", "template_text", "Occurrences", "samples")


@query()
def mine_templates(spark, sf_dir):
    """Merge and split."""
    return _mined(spark, sf_dir)


@query()
def mine_contained(spark, sf_dir):
    """Merge and split, templates that others cover included."""
    return _mined(spark, sf_dir, contained=True)


@query()
def mine_merge(spark, sf_dir):
    return _mined(spark, sf_dir, split=False)


@query(f"SELECT dataset, content AS template_text, count(*) AS Occurrences, CAST(1 AS BIGINT) AS samples FROM ({_MASKED}) GROUP BY ALL")
def mine_identity(spark, sf_dir):
    """Neither merge nor split: each sample is its template."""
    found, names = mining.mine(masked_events(spark, sf_dir), merge=False, split=False)
    sizes = found.groupBy("template_id").agg(F.sum("log_num").alias("Occurrences"), F.count("*").alias("samples"))
    return names.join(sizes, "template_id").select("dataset", "template_text", "Occurrences", "samples")


@query(f"SELECT dataset, translate(content, '＜＞｛｝', '<>{{}}') AS template_text, count(*) AS Occurrences FROM ({_MASKED}) GROUP BY ALL")
def online_templates(spark, sf_dir):
    """Messages one after the other by the stateful miner. Kinds of messages are merged at first and parted again as their lines grow, so in the end each masked text is a template of its own."""
    rows = saved(masked_events(spark, sf_dir), "messages")
    log = saved(miner.mine_online(rows), "changes")
    named = match.structured(rows.withColumn("sample_id", F.xxhash64("dataset", "content")), *miner.events_now(log))
    return named.groupBy("dataset", F.col("EventTemplate").alias("template_text")).agg(F.count("*").alias("Occurrences"))


@query()
def online_changes(spark, sf_dir):
    """What the stateful miner changed, by kind and reason, over whole event and order messages."""
    log = miner.mine_online(saved(mining_lines(spark, sf_dir), "messages"))
    return log.groupBy("dataset", "kind", "reason").agg(F.count("*").alias("changes"))


@query()
def mine_vs_metric(spark, sf_dir):
    """Mined templates scored against the level or table that a line comes from."""
    rows = saved(mining_lines(spark, sf_dir), "messages")
    found, names = mining.mine(rows)
    lines = match.structured(rows.withColumn("sample_id", F.xxhash64("dataset", "content")), found, names).withColumnRenamed("EventTemplate", "parsed").select("dataset", F.split("content", "[: ]")[0].alias("truth"), "parsed")
    return scoring.scores(scoring.pair_table(lines)).select("dataset", "GA", "FGA", "tool_templates", "ground_templates")


@query(f"SELECT content, regexp_replace(content, '[0-9]+', '<*>', 'g') AS template FROM (SELECT DISTINCT 'user ' || user_id || ' did ' || event_type AS content FROM events)")
def llm_cached_extract(spark, sf_dir):
    """A provider that stands for a language model: it wraps numbers; the cache already holds half of the answers."""

    def provider(prompt: str) -> str:
        import re

        return "`" + re.sub(r"[0-9]+", "<<n>>", prompt.split("`")[1]) + "`"

    texts = _read(spark, sf_dir, "events").select(F.concat(F.lit("user "), "user_id", F.lit(" did "), "event_type").alias("content"))
    _, cache = extract(texts.where(F.col("content").like("%click%")), provider)
    return extract(texts, provider, cache)[0]
