"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sawmill.llm.decontam import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sawmill.llm.secrets import secret_findings

    return secret_findings(_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sawmill.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sawmill.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sawmill.llm.embed import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sawmill.llm.packing import best_fit_packing

    return best_fit_packing(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sawmill.llm.warc import page_captures

    return page_captures(spark, _table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sawmill.llm.linededup import without_repeated_passages

    return without_repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as op8_line_dedup, under the name from before it removed whole passages too."""
    from sawmill.llm.linededup import without_repeated_passages

    return without_repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op9_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sawmill.llm.sharding import shards_by_bytes

    return shards_by_bytes(_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sawmill.llm.pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents")).withColumn("scores", F.expr("array_join(transform(scores, x -> format_number(x, 2)), ',')"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sawmill.llm.qualityrules import quality_rules

    rows = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics that the rules of op11 are about, and the verdict of its fixed rules."""
    from sawmill.llm.qualityrules import STATISTICS, base_failed, statistics

    return statistics(_table(spark, sf_dir, "documents")).select("row.doc_id", *STATISTICS, base_failed().alias("base_failed"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sawmill.llm.filteraudit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sawmill.llm.periodic import periodic_texts

    return periodic_texts(_table(spark, sf_dir, "documents"), plant=True).drop("runs", "collapsed")


def packing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a packing: rows that don't begin where the one before them in their sequence ends, sequences that are too long, documents and their ids."""
    from sawmill.llm.packing import CAPACITY

    rows = op6_best_fit_packing(spark, sf_dir)
    before = F.lag(F.col("offset") + F.col("length")).over(Window.partitionBy("sequence_id").orderBy("offset"))  # a sequence has at most CAPACITY rows
    rows = rows.withColumn("gap", F.col("offset") != F.coalesce(before, F.lit(0))).withColumn("long", F.col("offset") + F.col("length") > CAPACITY)
    cut = (F.col("start") != F.col("piece") * CAPACITY) | (F.col("length") < 1)
    count = lambda c: F.count(F.when(c, 1))
    return rows.agg(count(F.col("gap")).alias("gaps"), count(F.col("long")).alias("too_long"), count(cut).alias("wrong_cuts"), count(F.col("piece") == 0).alias("documents"), F.sum(F.when(F.col("piece") == 0, F.col("doc_id"))).alias("ids"))


def classifier_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the classifier: a row for each document, scores of 0 to 1, and four of five labels held out are met."""
    rows, labels = op4_quality_classifier(spark, sf_dir), _table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    wrong = (F.col("held_out") != held) | ~F.col("score").between(0, 1) | (F.col("predicted") != F.when(F.col("score") >= 0.7, 1).otherwise(0))
    met = F.avg(F.when(F.col("held_out"), (F.col("predicted") == F.col("quality")).cast("double"))) >= 0.8
    return rows.join(labels, "doc_id", "left").agg(F.count("*").alias("documents"), F.count(F.when(wrong, 1)).alias("wrong"), met.alias("met"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_warc": op7_warc,
    "op8_line_dedup": op8_line_dedup,
    "op8_passage_dedup": op8_passage_dedup,
    "op9_minimax_sharding": op9_minimax_sharding,
    "op10_personal_data": op10_personal_data,
    "op11_quality_rules": op11_quality_rules,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
    "rule_statistics": rule_statistics,
    "packing_check": packing_check,
    "classifier_check": classifier_check,
}

OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT g.rid, g.i, g.n, p.item_id FROM g JOIN p ON g.n = p.n AND g.phrase = p.phrase),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS original FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS id, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, id, i, len(ls) AS n, ls[i] AS line, CAST('0x' || substr(md5(ls[i]), 1, 7) AS BIGINT) AS h, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS w FROM (SELECT rid, id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT *, CASE WHEN i > 1 AND ((lag(h) OVER v * 31 + h) % 1000003) % 2 = 0 THEN 1 ELSE 0 END AS cut, sum(w) OVER v AS upto FROM l WINDOW v AS (PARTITION BY rid ORDER BY i)),
k AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM c),
f AS (SELECT rid, i, w, upto FROM c WHERE w > 0),
r AS (
  SELECT rid, min(i) AS a, max(i) AS b FROM k GROUP BY rid, no HAVING count(*) >= 2
  UNION SELECT rid, i, i + 2 FROM l WHERE i + 2 <= n
  UNION SELECT x.rid, x.i, min(y.i) FROM f x JOIN f y ON x.rid = y.rid AND y.i >= x.i AND y.upto - x.upto + x.w > 50 GROUP BY x.rid, x.i
  UNION SELECT y.rid, max(x.i), y.i FROM f x JOIN f y ON x.rid = y.rid AND y.i >= x.i AND y.upto - x.upto + x.w > 50 GROUP BY y.rid, y.i),
t AS (SELECT r.rid, d.id, a, b, array_to_string(ls[a:b], chr(10)) AS body FROM r JOIN d USING (rid)),
o AS (SELECT rid, a, b, id <> min(id) OVER (PARTITION BY body, b - a) OR row_number() OVER (PARTITION BY rid, body, b - a ORDER BY a) > 1 AS copy FROM t),
g AS (SELECT DISTINCT rid, unnest(range(a, b + 1)) AS i FROM o WHERE copy),
s AS (SELECT l.rid, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS new_text FROM l LEFT JOIN g ON l.rid = g.rid AND l.i = g.i GROUP BY l.rid)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN new_text END AS text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN s USING (rid)
"""

OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
c AS (SELECT min(rid) AS cls, n, list(rid) AS rids FROM (SELECT rid, count(*) AS n, list_sort(list(s)) AS k FROM g GROUP BY rid) GROUP BY n, k),
q AS (SELECT s, cls, n FROM g JOIN c ON rid = cls),
p AS (SELECT a.cls AS a, b.cls AS b FROM q a JOIN q b ON a.s = b.s AND a.cls < b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
m AS (SELECT cls, unnest(rids) AS rid FROM c),
x AS (SELECT cls, doc_id FROM m JOIN d USING (rid) WHERE doc_id IS NOT NULL),
e AS (SELECT u.doc_id AS a, v.doc_id AS b FROM (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT cls, cls FROM c) l JOIN (SELECT cls, min(doc_id) AS doc_id FROM x GROUP BY cls) v ON l.b = v.cls JOIN x u ON l.a = u.cls),
y AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t AS (SELECT DISTINCT a AS node, a AS root FROM y UNION SELECT t.node, y.b FROM t JOIN y ON t.root = y.a),
o AS (SELECT node, min(root) AS component FROM t GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(CASE WHEN n > 0 THEN component END, doc_id) AS component_id, coalesce(doc_id = coalesce(CASE WHEN n > 0 THEN component END, doc_id), true) AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN o ON doc_id = node
"""

OP5_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
u AS (SELECT rid, vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.rid AS r, a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.rid <> b.rid WHERE list_dot_product(a.v, b.v) >= 0.93),
t AS (SELECT DISTINCT a AS node, a AS root FROM p UNION SELECT t.node, p.b FROM t JOIN p ON t.root = p.a),
c AS (SELECT node, min(root) AS component FROM t GROUP BY node),
n AS (SELECT r, count(*) AS links FROM p GROUP BY r)
SELECT e.vec_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, coalesce(component, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(component, e.vec_id), true) AS kept
FROM e LEFT JOIN c ON e.vec_id = node LEFT JOIN n ON e.rid = n.r
"""

OP9_SQL = """
WITH RECURSIVE r AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
p AS (SELECT key, CAST(s AS BIGINT) AS s, CAST(sum(s) OVER (ORDER BY key) AS BIGINT) AS upto FROM (SELECT key, sum(size) AS s FROM r GROUP BY key)),
b AS (SELECT greatest(max(s), (max(upto) + 15) // 16) AS least, max(upto) AS total FROM p),
-- the capacity between low and high is tried shard by shard: used shards hold the sizes up to placed
x AS (
  SELECT least AS low, total AS high, CAST(0 AS BIGINT) AS placed, 0 AS used FROM b
  UNION ALL
  SELECT CASE WHEN placed < total AND used = 16 THEN (low + high) // 2 + 1 ELSE low END, CASE WHEN placed = total THEN (low + high) // 2 ELSE high END,
         CASE WHEN placed < total AND used < 16 THEN (SELECT max(upto) FROM p WHERE upto <= x.placed + (x.low + x.high) // 2) ELSE 0 END, CASE WHEN placed < total AND used < 16 THEN used + 1 ELSE 0 END
  FROM x, b WHERE low < high),
cap AS (SELECT max(low) AS c FROM x WHERE low = high),
cuts AS (
  SELECT 0 AS k, CAST(0 AS BIGINT) AS placed
  UNION ALL SELECT k + 1, (SELECT max(upto) FROM p, cap WHERE upto <= cuts.placed + c) FROM cuts, b WHERE placed < total),
g AS (SELECT key, (SELECT count(*) FROM cuts WHERE k > 0 AND placed <= p.upto - p.s) AS shard FROM p),
tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS v FROM range(256) q(i))),
u AS (SELECT DISTINCT t, hex(encode(t)) AS h FROM r),
crc AS (SELECT t, xor(list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)), lambda c, v: xor(c >> 8, tab[CAST((xor(c, v) & 255) + 1 AS BIGINT)]), 4294967295), 4294967295) AS text_crc32 FROM u, tab)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN g USING (key) JOIN crc USING (t)
"""

_IBAN = "([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)($|[^A-Za-z0-9])"


def _pii_kind(order: int, kind: str, pattern: str) -> str:
    return f"SELECT rid, {order} AS o, '{kind}' AS kind, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d"


def _pii_cue(kind: str, score: float, words: str) -> str:
    return f"('{kind}', {score}, '\\b(?:{words})s?\\b')"


OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({_pii_kind(0, 'email', r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')}
  UNION ALL {_pii_kind(1, 'ip', r'[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')}
  UNION ALL {_pii_kind(2, 'card', r'[0-9](?:[\x20-]?[0-9])+')}
  UNION ALL {_pii_kind(3, 'phone', r'\+[0-9][\x20().0-9-]+[0-9]')}),
m AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM x WHERE len(ms) > 0),
s AS (SELECT rid, o, kind, ms[i] AS v, regexp_replace(ms[i], '[^0-9]', '', 'g') AS g, CAST(list_sum(list_transform(gs[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS a FROM m),
base AS (SELECT rid, o, kind, a, a + length(v) AS b FROM s WHERE CASE kind
  WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(TRY_CAST(ltrim(y, '0') AS INTEGER), 0) > 255)) = 0
  WHEN 'card' THEN length(g) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(reverse(g), k, 1) AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(reverse(g), k, 1) AS INTEGER) + 1] END)) % 10 = 0
  WHEN 'phone' THEN length(g) BETWEEN 9 AND 15 ELSE true END),
-- bank accounts: the first match from pos on, its longest end before a space that passes the check, and on from there
w AS (
  SELECT rid, t, CAST(1 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS n FROM d WHERE regexp_matches(t, '(^|[^A-Za-z0-9]){_IBAN}')
  UNION ALL
  SELECT rid, t, a0 + coalesce(n0, 4) + 1, a0, n0
  FROM (
    SELECT rid, t, a0, list_max(list_filter(list_append(list_transform(list_filter(range(1, length(v) + 1), lambda k: substr(v, k, 1) = ' '), lambda k: k - 1), length(v)), lambda e:
      length(replace(substr(v, 1, e), ' ', '')) BETWEEN 15 AND 34 AND
      list_reduce(list_transform(string_split(substr(replace(substr(v, 1, e), ' ', ''), 5) || substr(v, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ord(c) - 48 AS BIGINT) ELSE CAST(ord(c) - 55 AS BIGINT) END), lambda acc, c: (acc * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97, 0) = 1)) AS n0
    FROM (
      SELECT rid, t, h[3] AS v, greatest(pos - 1, 1) - 1 + length(h[1]) + length(h[2]) AS a0
      FROM (SELECT rid, t, pos, CASE WHEN pos = 1 THEN regexp_extract_all(t, '(?s)^(.*?)(^|[^A-Za-z0-9]){_IBAN}', 0) ELSE regexp_extract_all(substr(t, pos - 1), '(?s)^(.*?)([^A-Za-z0-9]){_IBAN}', 0) END AS any_, CASE WHEN pos = 1 THEN [regexp_extract(t, '(?s)^(.*?)(^|[^A-Za-z0-9]){_IBAN}', 1), regexp_extract(t, '(?s)^(.*?)(^|[^A-Za-z0-9]){_IBAN}', 2), regexp_extract(t, '(?s)^(.*?)(^|[^A-Za-z0-9]){_IBAN}', 3)] ELSE [regexp_extract(substr(t, pos - 1), '(?s)^(.*?)([^A-Za-z0-9]){_IBAN}', 1), regexp_extract(substr(t, pos - 1), '(?s)^(.*?)([^A-Za-z0-9]){_IBAN}', 2), regexp_extract(substr(t, pos - 1), '(?s)^(.*?)([^A-Za-z0-9]){_IBAN}', 3)] END AS h FROM w)
      WHERE len(any_) > 0))),
every AS (SELECT rid, o, kind, a, b FROM base UNION ALL SELECT rid, 4, 'iban', a, a + n FROM w WHERE n IS NOT NULL),
cue AS (SELECT * FROM (VALUES {_pii_cue('email', 0.9, 'mail|email|contact|write')}, {_pii_cue('ip', 0.6, 'ip|address|host|server')}, {_pii_cue('card', 0.8, 'card|visa|payment|credit|pay')},
  {_pii_cue('phone', 0.7, 'phone|call|tel|mobile|fax')}, {_pii_cue('iban', 0.95, 'iban|bank|account|transfer')}) q(kind, score, pattern)),
scored AS (SELECT rid, o, e.kind, a, b, least(1.0, greatest(0.0, score + CASE WHEN regexp_matches(near, pattern) THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(near, '\b(?:example|sample|test|version|order|invoice|serial)s?\b') THEN 0.3 ELSE 0 END)) AS score
  FROM (SELECT every.*, translate(substr(t, greatest(a - 40, 0) + 1, least(a, 40)) || ' ' || substr(t, b + 1, 40), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS near FROM every JOIN d USING (rid)) e JOIN cue USING (kind)),
o AS (SELECT rid, count(*) FILTER (o = 0) AS n_email, count(*) FILTER (o = 1) AS n_ip, count(*) FILTER (o = 2) AS n_card, count(*) FILTER (o = 3) AS n_phone,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o, b) FILTER (o < 4) AS based, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o, b) AS spans, string_agg(printf('%.2f', CAST(score AS DOUBLE)), ',' ORDER BY a, o, b) AS scores FROM scored GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN o USING (rid)
"""

RULE_STATISTICS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
ls AS (SELECT rid, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines FROM l GROUP BY rid),
g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT rid, count(DISTINCT k) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1) GROUP BY rid),
s AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct,
         CAST(length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_uppers, CAST(length(t) - length(translate(t, '0123456789', '')) AS BIGINT) AS n_digits,
         CAST(length(t) - length(regexp_replace(t, '[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS BIGINT) AS n_signs
  FROM d LEFT JOIN ls USING (rid) LEFT JOIN r USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
y AS (SELECT doc_id, max(CAST(quality IS NOT DISTINCT FROM 1 AS INTEGER)) AS good, max(CAST(toxic IS NOT DISTINCT FROM 1 AS INTEGER)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > first, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM t JOIN m USING (text) LEFT JOIN y USING (doc_id)),
c AS (SELECT part, CAST(a AS INTEGER) + 2 * CAST(b AS INTEGER) + 4 * CAST(c AS INTEGER) + 8 * CAST(d AS INTEGER) + 16 * CAST(e AS INTEGER) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM l p, l q, l r, l s, l u WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
k AS (
  SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own, CAST(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS BIGINT) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
s AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
         sum(n) FILTER (fails & (coalesce(before, 0) + own) = 0) AS kept, sum(n) FILTER (fails & coalesce(before, 0) = 0 AND fails & own <> 0) AS removed, sum(n) FILTER (fails & coalesce(before, 0) <> 0 AND fails & own <> 0) AS redundant,
         sum(n) FILTER (fails = own) AS unique_fails, sum(good) FILTER (fails & coalesce(before, 0) = 0 AND fails & own <> 0) AS good_lost, sum(toxic) FILTER (fails & coalesce(before, 0) = 0 AND fails & own <> 0) AS toxic_lost
  FROM c, k GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM s
"""

OP13_SQL = r"""
WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS v FROM range(256) q(i))),
z AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, v: xor(c >> 8, tab[CAST((xor(c, v) & 255) + 1 AS BIGINT)]), 4294967295), 4294967295) END AS h
  FROM documents, tab),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM z),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) END AS w FROM p),
x AS (SELECT rid, n, i - 1 AS i, w[i] AS word FROM (SELECT rid, n, w, unnest(range(1, n + 1)) AS i FROM d)),
e AS (SELECT u.rid, v.i - u.i AS q, u.i FROM x u JOIN x v ON u.rid = v.rid AND u.word = v.word AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS no FROM e) GROUP BY rid, q, no HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT rid, start, length, min(q) AS period FROM s GROUP BY rid, start, length),
b AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         first(struct_pack(start := start, length := length, period := period) ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS best
  FROM r GROUP BY rid),
g AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN g ON x.rid = g.rid AND x.i = g.i WHERE g.i IS NULL GROUP BY x.rid)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
       CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": OP1_SQL,
    "op3_minhash_near_dedup": OP3_SQL,
    "op5_embedding_near_dedup": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op8_passage_dedup": OP8_SQL,
    "op9_minimax_sharding": OP9_SQL,
    "op10_personal_data": OP10_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
    "rule_statistics": RULE_STATISTICS_SQL,
    "packing_check": "SELECT CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS wrong_cuts, count(*) AS documents, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents",
    "classifier_check": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS wrong, true AS met FROM documents",
}
