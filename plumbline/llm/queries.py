"""The operators' registered queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from plumbline.catalog.base import registrar
from plumbline.llm import align, decontaminate, exact_dedup, mixing, near_dedup, pii, quality, secret_scan, spelling, substring_dedup, suffix_dedup, toxicity, url_filter

Q, SQL, query = registrar()

ROOT = str(Path(__file__).resolve().parents[2])

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark, sf, name):
    """A given table; Python workers started from now on find this package where it isn't installed."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{path}:{ROOT}".strip(":")
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op3_mixing", r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source
    NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
c AS (SELECT d.doc_id, d.size, d.h, p.*, target - passes * source_size AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
  sum(d.size) OVER (PARTITION BY d.source, d.h) AS own FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (passes + CASE WHEN upto <= rest THEN 1
  WHEN upto - own <= rest AND upto - rest < rest - (upto - own) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c""")
def op3(spark, sf):
    return mixing.mix_sizes(table(spark, sf, "documents"))


@query("op6_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256({LOWERED}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d""")
def op6(spark, sf):
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


TERM = r"""regexp_matches(u, '(^|[^a-z0-9])({})([^a-z0-9]|$)')"""


@query("op5_url_filter", rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
 translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM pages),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
 {TERM.format("|".join(url_filter.STRICT))} AS strict,
 {" + ".join(f"CASE WHEN {TERM.format(t)} THEN 1 ELSE 0 END" for t in url_filter.SOFT)} AS n,
 {" + ".join(f"CASE WHEN {TERM.format(t)} THEN {w}::DOUBLE ELSE 0 END" for t, w in url_filter.SOFT.items())} AS weight FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
 WHEN strict OR (n > 1 AND weight >= {url_filter.LIMIT}) THEN 'block' ELSE 'allow' END AS verdict FROM r""")
def op5(spark, sf):
    return url_filter.judge(table(spark, sf, "pages")).drop("strict_terms", "soft_terms")


@query("op7_decontamination", rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS g
  FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) t(i) WHERE len(w) > 0),
k AS (SELECT DISTINCT n FROM g),
x AS (SELECT r, i, k.n, list_slice(w, i, i + k.n - 1) AS g FROM d, k, unnest(range(1, len(w) - k.n + 2)) t(i) WHERE len(w) >= k.n),
h AS (SELECT x.r, x.i, x.n, g.item_id FROM x JOIN g ON x.n = g.n AND x.g = g.g),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM h, unnest(range(i, i + n)) t(q) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN s USING (r)""")
def op7(spark, sf):
    found = decontaminate.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op9_toxicity")
def op9(spark, sf):
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


@query("op10_quality")
def op10(spark, sf):
    return quality.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op1_near_dedup", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 2 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT doc_id, doc_id AS m FROM s UNION SELECT e.b, c.m FROM c JOIN e ON c.doc_id = e.a),
k AS (SELECT doc_id, min(m) AS m FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m AS component_id, doc_id = m AS kept FROM s JOIN k USING (doc_id)""")
def op1(spark, sf):
    return near_dedup.near_groups(table(spark, sf, "documents"), size=near_dedup.SHINGLE, share=near_dedup.SHARE)


def _found(k, rule):
    """Spans of one rule: running sums of the lengths of matches and of the pieces between them."""
    p = rule.pattern.replace("'", "''")
    long = f"length(regexp_extract(v, '{p}', {rule.group})) >= {rule.least}"
    return f"""SELECT r, {k} AS k, a, a + length(v) AS z FROM (SELECT r, ms[i] AS v, list_sum(list_transform(ps[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a FROM (SELECT r, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM
  (SELECT r, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}')))) WHERE {long}"""


_NAMES = "[" + ", ".join(f"'{r.name}'" for r in secret_scan.RULES) + "]"
_JOINED = f"string_agg({_NAMES}[k + 1] || ':' || CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT), ',' ORDER BY a, k)"


@query("op8_secret_scan", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_found(k, r) for k, r in enumerate(secret_scan.RULES))}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.name}" for k, r in enumerate(secret_scan.BASE))},
  {_JOINED} FILTER (WHERE k < {len(secret_scan.BASE)}) AS b, {_JOINED} AS spans FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in secret_scan.BASE)}, sha256(coalesce(b, '')) AS base_sha256,
 coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)""")
def op8(spark, sf):
    return secret_scan.counted(secret_scan.scan(table(spark, sf, "documents")))


@query("op4_pii")
def op4(spark, sf):
    docs = table(spark, sf, "documents")
    return pii.counted(pii.scan(docs, pii.fit(docs)))


@query("op2_substring_dedup")
def op2(spark, sf):
    return substring_dedup.repeats(table(spark, sf, "documents"))


@query("op13_spelling", r"""
WITH RECURSIVE table_of AS (SELECT list(CAST(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
  AS BIGINT) ORDER BY b) AS t FROM range(256) r(b)),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
o AS (SELECT w, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT w, n, hex(encode(s)) AS x FROM o),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
  lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1])), 4294967295) AS h FROM b, table_of),
c AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS g FROM v, unnest(range(1, length(word) + 1)) t(i)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM g a JOIN g b ON a.g = b.g AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM g a JOIN v b ON a.g = b.word UNION SELECT b.word, a.word, a.n FROM g a JOIN v b ON a.g = b.word),
k AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN m END AS form_n,
  CASE WHEN m >= 5 * v.n THEN (SELECT min(near) FROM p WHERE p.word = v.word AND p.m = k.m) END AS form FROM v LEFT JOIN k USING (word)),
e AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT e.word, f.form FROM e JOIN f ON e.root = f.word WHERE f.form IS NOT NULL),
z AS (SELECT word, root FROM e JOIN f USING (word) WHERE root IN (SELECT word FROM f WHERE form IS NULL))
SELECT f.word, f.form, coalesce(z.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN z USING (word)""".replace("\\u00C0-\\u00FF", "\u00C0-\u00FF"))
def op13(spark, sf):
    return spelling.variants(spelling.vocabulary(table(spark, sf, "documents"), slip=199))


@query("op12_alignment")
def op12(spark, sf):
    return align.alignments(table(spark, sf, "documents"))


@query("op11_suffix_dedup", """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
b AS (SELECT r, k, substr(x, 400 * k + 1, 798) AS x FROM d, unnest(range(0, len(x) // 400)) t(k)),
w AS (SELECT r, 200 * k + i AS i, md5(substr(x, 2 * i + 1, 400)) AS g FROM b, unnest(range(0, len(x) // 2 - 199)) t(i) WHERE len(x) >= 400),
a AS (SELECT r, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
t AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM a),
k AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM t),
s AS (SELECT r, k, min(i) AS a, max(i) + 200 AS z FROM k GROUP BY r, k),
p AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS b FROM s),
o AS (SELECT r, count(*) AS n, sum(z - a) AS m, max(z) AS z, string_agg(substr(x, CAST(2 * b + 1 AS BIGINT), CAST(2 * (a - b) AS BIGINT)), '' ORDER BY a) AS y
  FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(y, '') || substr(x, CAST(2 * coalesce(z, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM d LEFT JOIN o USING (r)""")
def op11(spark, sf):
    return suffix_dedup.repeats(table(spark, sf, "documents")).drop("runs")
