"""Queries over scans, registry rules, the manifest and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.functions import ranking as R
from plumbline.functions import scalar as S
from plumbline.operators import ingest as I
from plumbline.operators import manifest as M
from plumbline.operators import sketches as K
from plumbline.sources import metadata as MD
from plumbline.catalog.base import r6, registrar, rows
from plumbline.catalog.sqltext import MANIFEST, RAW, SPLIT, quantile, with_views

Q, SQL, query = registrar()


# ---- scans --------------------------------------------------------------------------------------

def registry(spark, sf):
    """One entry per dataset named by the documents."""
    m = B.raw_manifest(spark, sf)
    return m.groupBy(F.col("dataset").alias("name")).agg(
        F.min("kind").alias("media_type"), F.min("source_path").alias("path"),
        F.min("content_category").alias("content_category"))


REGISTRY = ", reg AS (SELECT dataset name, min(kind) media_type, min(source_path) path, min(content_category) content_category FROM raw GROUP BY 1)"


@query("registry_duplicates", "SELECT name, count(*) n FROM (SELECT DISTINCT source name, lang FROM documents) GROUP BY 1 HAVING count(*)>1")
def _(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("source").alias("name"), "lang").distinct()
    return M.duplicate_names(d)


@query("sample_metadata", """SELECT event_id, k.key AS field, CAST(k.value AS VARCHAR) AS value
FROM events, json_each(props) k""")
def _(spark, sf):
    return MD.metadata_fields(B.table(spark, sf, "events"), "event_id", "props")


@query("benchmark_records", """SELECT vec_id, concat('emb-',label) dataset_name,
 round(1-1/(1+exp(4*CAST(embedding[1] AS DOUBLE))),6) p_fake, CASE WHEN label%3>0 THEN 1 ELSE 0 END y,
 CASE WHEN vec_id%5=0 THEN FALSE ELSE vec_id%5=1 END aug FROM embeddings WHERE vec_id%11<>0""")
def _(spark, sf):
    recs = MD.read_records(records(spark, sf))
    return recs.select("vec_id", "dataset_name", r6("p_fake"), "y", "aug")


def records(spark, sf):
    """Benchmark records with null probabilities and a nullable pass flag."""
    e = B.table(spark, sf, "embeddings")
    p_real = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(4.0) * F.element_at("embedding", 1).cast("double")))
    return e.select("vec_id", F.concat(F.lit("emb-"), F.col("label").cast("string")).alias("dataset_name"),
                    (F.col("label") % 3).alias("label"),
                    F.when(F.col("vec_id") % 11 != 0, F.array(p_real, 1 - p_real)).alias("probs"),
                    F.when(F.col("vec_id") % 5 != 0, F.col("vec_id") % 5 == 1).alias("aug_pass"))


@query("tally_documents", """WITH psa AS (SELECT CASE CAST(user_id%3 AS INT) WHEN 0 THEN 'real' WHEN 1 THEN 'synthetic' ELSE 'semisynthetic' END truth,
 concat('set-',user_id) dataset, event_type pred_label, count(*) n FROM events GROUP BY 1,2,3) SELECT * FROM psa""")
def _(spark, sf):
    e = B.table(spark, sf, "events")
    u = F.col("user_id")
    truth = F.when(u % 3 == 0, "real").when(u % 3 == 1, "synthetic").otherwise("semisynthetic")
    c = (e.groupBy(truth.alias("truth"), F.concat(F.lit("set-"), u.cast("string")).alias("dataset"), "event_type")
         .agg(F.count(F.lit(1)).alias("n")))
    docs = c.groupBy("truth", "dataset").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("p"))
    doc = F.to_json(F.create_map("truth", F.create_map("dataset", "p"))).alias("doc")
    return MD.read_tallies(docs.select(doc), "doc")


@query("name_list_rows", "WITH " + MANIFEST + """ SELECT dataset, count(*) n FROM m
 WHERE dataset IN ('src0-en','src1-de','src2-fr','src3-es') GROUP BY 1""")
def _(spark, sf):
    names = MD.name_list(spark, ["src0-en", "src1-de", "src2-fr", "src3-es", "nowhere"])
    m = B.manifest(spark, sf)
    return (m.join(F.broadcast(names), m["dataset"] == names["name"], "left_semi")
            .groupBy("dataset").agg(F.count(F.lit(1)).alias("n")))


PATH = "concat('/old/datasets/', regexp_replace(url,'^https?://',''), CASE WHEN page_id%3=0 THEN '/datasets/a/b.png' ELSE '' END)"


@query("path_reroot", f"""SELECT page_id, CASE WHEN page_id%7=0 THEN url ELSE
 concat('/new/', regexp_extract({PATH}, '^(?:.*/)?(datasets(?:/.*)?)$', 1)) END path FROM pages""")
def _(spark, sf):
    p = B.table(spark, sf, "pages").select("page_id", "url")
    tail = F.when(F.col("page_id") % 3 == 0, "/datasets/a/b.png").otherwise("")
    path = F.when(F.col("page_id") % 7 == 0, F.col("url")).otherwise(
        F.concat(F.lit("/old/datasets/"), F.regexp_replace("url", "^https?://", ""), tail))
    return p.select("page_id", S.reroot(path, "/new").alias("path"))


@query("staged_remaining", "WITH " + RAW + """, h AS (SELECT dataset, count(*) have FROM raw GROUP BY 1)
 SELECT dataset, have, CAST(16-have AS BIGINT) missing FROM h WHERE NOT (have>=0.9*16 OR have>=500)""")
def _(spark, sf):
    return I.staging_plan(B.raw_manifest(spark, sf), "dataset", 16).select("dataset", "have", "missing")


NORM = "lower(trim(regexp_replace(text,'\\s+',' ','g')))"


@query("ingest_dedup", f"""WITH k AS (SELECT doc_id, source, sha1(text) h FROM documents WHERE n_chars>=256),
 f AS (SELECT h, min(doc_id) doc_id FROM k GROUP BY 1)
 SELECT k.doc_id, source source_file, concat('item_', lpad(CAST(row_number() OVER (ORDER BY k.doc_id)-1 AS VARCHAR),CAST(greatest(length(CAST(row_number() OVER (ORDER BY k.doc_id)-1 AS VARCHAR)),9) AS INT),'0')) fname
 FROM k JOIN f USING (doc_id)""")
def _(spark, sf):
    d = B.table(spark, sf, "documents").withColumnRenamed("source", "source_file")
    kept = I.ingest(d, content="text", size="n_chars", order="doc_id", min_side=256, digits=9, stem="item_")
    return kept.select("doc_id", "source_file", "fname")


@query("ingest_counts", """WITH k AS (SELECT source, n_chars, row_number() OVER (PARTITION BY sha1(text), n_chars>=256 ORDER BY doc_id) rn FROM documents)
 SELECT source source_file, count(*) FILTER (WHERE n_chars>=256 AND rn=1) kept, count(*) FILTER (WHERE n_chars<256) too_small,
 count(*) FILTER (WHERE n_chars>=256 AND rn>1) repeated FROM k GROUP BY 1""")
def _(spark, sf):
    d = B.table(spark, sf, "documents").withColumnRenamed("source", "source_file")
    return I.ingest_counts(d, content="text", size="n_chars", order="doc_id", min_side=256, by="source_file")


@query("ingest_capped", """WITH k AS (SELECT doc_id, source, sha1(text) h FROM documents WHERE n_chars>=256),
 f AS (SELECT h, source, min(doc_id) doc_id FROM k GROUP BY 1,2),
 r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id)-1 i FROM f)
 SELECT doc_id, source source_file, concat('img_', lpad(CAST(i AS VARCHAR),CAST(greatest(length(CAST(i AS VARCHAR)),6) AS INT),'0')) fname FROM r WHERE i<30""")
def _(spark, sf):
    d = B.table(spark, sf, "documents").withColumnRenamed("source", "source_file")
    kept = I.ingest(d, content="text", size="n_chars", order="doc_id", min_side=256, by=["source_file"], max_n=30)
    return kept.select("doc_id", "source_file", "fname")


@query("pseudo_shards", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)-1 i FROM documents)
 SELECT doc_id, concat(source,'#shard',CAST(i//500 AS VARCHAR)) shard, concat(source,'#blk',CAST(i//64 AS VARCHAR)) block FROM r""")
def _(spark, sf):
    d = R.ordered_position(B.table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id")
    return d.select("doc_id", I.pseudo_shard(F.col("source"), F.col("position"), 500, "shard").alias("shard"),
                    I.pseudo_shard(F.col("source"), F.col("position"), 64, "blk").alias("block"))


# ---- field rules --------------------------------------------------------------------------------

@query("media_labels", """SELECT user_id, event_type, CASE WHEN lower(trim(mt))='real' THEN 0 ELSE 1 END label, count(*) n
 FROM (SELECT user_id, event_type, CASE event_type WHEN 'view' THEN ' Real ' WHEN 'click' THEN 'real' ELSE event_type END mt FROM events) GROUP BY ALL""")
def _(spark, sf):
    e = B.table(spark, sf, "events")
    mt = F.when(F.col("event_type") == "view", " Real ").when(F.col("event_type") == "click", "real").otherwise(F.col("event_type"))
    return (e.groupBy("user_id", "event_type", S.media_label(mt).alias("label")).agg(F.count(F.lit(1)).alias("n")))


@query("source_formats", """SELECT doc_id, CASE WHEN doc_id%4=0 THEN 'unknown' WHEN doc_id%4=1 THEN 'jpeg' WHEN doc_id%4=2 THEN 'unknown' ELSE lang END source_format FROM documents""")
def _(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "lang")
    raw = (F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 4 == 1, " JPG ")
           .when(F.col("doc_id") % 4 == 2, "").otherwise(F.upper("lang")))
    return d.select("doc_id", S.source_format(raw).alias("source_format"))


@query("extensions", """SELECT doc_id, CASE WHEN doc_id%3=0 THEN 'jpg' WHEN doc_id%3=1 THEN 'png' ELSE lang END ext FROM documents""")
def _(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "lang")
    raw = F.when(F.col("doc_id") % 3 == 0, ".JPEG").when(F.col("doc_id") % 3 == 1, ".png").otherwise(F.concat(F.lit("."), F.col("lang")))
    return d.select("doc_id", S.extension(raw).alias("ext"))


@query("file_indexes", """SELECT doc_id, CASE WHEN doc_id%5=0 THEN -1 WHEN doc_id%5=1 THEN -1 ELSE doc_id END file_index FROM documents""")
def _(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id")
    n = S.padded(F.col("doc_id"), 6)
    name = (F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("a_b/plain"), n, F.lit(".png")))
            .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("img_"), n, F.lit("x.jpg")))
            .otherwise(F.concat(F.lit("d/img_"), n, F.lit(".jpg"))))
    return d.select("doc_id", S.file_index(name).alias("file_index"))


@query("row_ids", """SELECT event_id, CASE WHEN event_id%2=0 THEN concat(event_type,'/',isoyear(ts),'W',lpad(CAST(week(ts) AS VARCHAR),2,'0'),'/f',event_id)
 ELSE concat(event_type,'/f',event_id) END image_id FROM events""")
def _(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", "ts", "event_type")
    week = F.when(F.col("event_id") % 2 == 0, MD.iso_week(F.col("ts"))).otherwise("")
    return e.select("event_id", S.row_id(F.col("event_type"), week, F.concat(F.lit("f"), F.col("event_id").cast("string"))).alias("image_id"))


@query("geometry", "WITH " + MANIFEST + """ SELECT image_id, min_side, max_side, round(aspect,6) aspect, round(megapixels,6) megapixels,
 round(bytes_per_pixel,6) bytes_per_pixel, round(m_eval,6) m_eval FROM m""")
def _(spark, sf):
    m = B.raw_manifest(spark, sf)
    return m.select("image_id", "min_side", "max_side", r6("aspect"), r6("megapixels"), r6("bytes_per_pixel"), r6("m_eval"))


@query("resolved_kinds", "WITH " + RAW + REGISTRY + """ SELECT name, CASE WHEN media_type='real' THEN 'real' WHEN name IN ('src1-fr','src2-en','src3-es') OR media_type='semisynthetic' THEN 'semisynthetic' ELSE 'synthetic' END kind,
 media_type NOT IN ('real','semisynthetic') AND name IN ('src1-fr','src2-en','src3-es') promoted FROM reg""")
def _(spark, sf):
    listed = MD.name_list(spark, ["src1-fr", "src2-en", "src3-es", "nowhere"])
    return M.resolve_kinds(registry(spark, sf), listed).select("name", "kind", "promoted")


@query("category_fixes", "WITH " + RAW + REGISTRY + """ SELECT name, CASE name WHEN 'src1-en' THEN 'aerial' WHEN 'src2-de' THEN 'faces' ELSE content_category END content_category_fixed FROM reg""")
def _(spark, sf):
    fixes = rows(spark, "src1-en|aerial;src2-de|faces;nowhere|x", "name string, fix string")
    return M.fix_categories(registry(spark, sf), fixes).select("name", "content_category_fixed")


@query("unknown_rule_names", "WITH " + RAW + " SELECT DISTINCT concat(source,'-xx') name FROM documents")
def _(spark, sf):
    rules = B.table(spark, sf, "documents").select(F.concat(F.col("source"), F.lit("-xx")).alias("name")).unionByName(
        registry(spark, sf).select("name"))
    return M.unknown_names(rules, registry(spark, sf))


@query("category_folding", "WITH " + MANIFEST + " SELECT content_category, category folded, count(*) n FROM m GROUP BY 1,2")
def _(spark, sf):
    return (B.manifest(spark, sf).groupBy("content_category", F.col("category").alias("folded"))
            .agg(F.count(F.lit(1)).alias("n")))


SHARDS = "a|0|gone-1;a|1|src1-en;a|2|src2-en;b|0|src3-de;b|1|src4-de;b|2|src5-de"


@query("release_groups", "WITH " + RAW + REGISTRY + """ SELECT name, CASE WHEN name IN ('src1-en','src2-en') THEN 'src1-en' WHEN name IN ('src3-de','src4-de','src5-de') THEN 'src3-de' ELSE name END release FROM reg""")
def _(spark, sf):
    shards = rows(spark, SHARDS, "shard_id string, pos string, name string")
    return M.release_groups(registry(spark, sf), shards).select("name", F.col("group").alias("release"))


@query("registry_with_local", "WITH " + RAW + REGISTRY + """ SELECT name, media_type FROM reg UNION ALL
 SELECT DISTINCT concat('local-',source), 'synthetic' FROM documents""")
def _(spark, sf):
    reg = registry(spark, sf).select("name", "media_type")
    extra = (B.table(spark, sf, "documents").select(F.concat(F.lit("local-"), F.col("source")).alias("name")).distinct()
             .unionByName(reg.select("name")).withColumn("media_type", F.lit("synthetic")))
    return M.add_missing(reg, extra)


@query("three_class_labels", "WITH " + RAW + " SELECT image_id, CASE WHEN label=0 THEN 0 WHEN kind='semisynthetic' THEN 2 ELSE 1 END y3 FROM raw")
def _(spark, sf):
    return B.raw_manifest(spark, sf).select("image_id", S.three_class(F.col("label"), F.col("kind")).alias("y3"))


@query("provenance_classes", """SELECT CASE WHEN user_id%7=0 THEN 'holdout' WHEN user_id%7=1 THEN 'stream' ELSE 'public' END provenance, count(*) n FROM events GROUP BY 1""")
def _(spark, sf):
    t = B.tallies(spark, sf)
    return t.groupBy(S.provenance(F.upper("dataset"), B.STREAM_MARKER).alias("provenance")).agg(F.sum("n").alias("n"))


@query("readable_rows", "WITH " + RAW + " SELECT dataset, count(*) FILTER (WHERE width>=200) readable, count(*) FILTER (WHERE width<200) dropped FROM raw GROUP BY 1")
def _(spark, sf):
    m = B.raw_manifest(spark, sf).withColumn("path", F.col("image_id"))
    good, bad = M.readable(m, m.filter("width >= 200"))
    both = good.select("dataset", F.lit(1).alias("ok")).unionByName(bad.select("dataset", F.lit(0).alias("ok")))
    return both.groupBy("dataset").agg(F.count(F.when(F.col("ok") == 1, 1)).alias("readable"),
                                       F.count(F.when(F.col("ok") == 0, 1)).alias("dropped"))


@query("split_slices", "WITH " + SPLIT + " SELECT split, dataset, count(*) n FROM s WHERE split IN ('val_id','val_xgen') AND label=1 GROUP BY 1,2")
def _(spark, sf):
    s = B.split_manifest(spark, sf)
    return (s.filter(F.col("split").isin("val_id", "val_xgen") & (F.col("label") == 1))
            .groupBy("split", "dataset").agg(F.count(F.lit(1)).alias("n")))


def holdouts(spark, sf):
    """Every fifth dataset by hash is a required holdout."""
    reg = registry(spark, sf)
    u = S.stable_fraction(F.col("name"), "hold")
    split = F.when(u < 0.1, "val_xgen").when(u < 0.2, "test").otherwise("val_stress")
    side = F.when(F.col("media_type") == "real", "real").otherwise("fake")
    return reg.filter(u < 0.3).select(split.alias("split"), side.alias("side"), "name")


from plumbline.catalog.sqltext import frac as _frac  # noqa: E402

HOLD = REGISTRY + f""", hold AS (SELECT CASE WHEN u<0.1 THEN 'val_xgen' WHEN u<0.2 THEN 'test' ELSE 'val_stress' END split,
 CASE WHEN media_type='real' THEN 'real' ELSE 'fake' END side, name FROM (SELECT *, {_frac('name', 'hold')} u FROM reg) WHERE u<0.3)"""


@query("holdout_names", "WITH " + RAW + HOLD + " SELECT split, side, name FROM hold")
def _(spark, sf):
    specs = holdouts(spark, sf).select("split", F.create_map("side", F.array("name")).alias("spec"))
    return M.names_from_spec(specs)


@query("gated_holdouts", "WITH " + RAW + HOLD + """ SELECT split, side, name FROM hold UNION
 SELECT 'test', CASE WHEN media_type='real' THEN 'real' ELSE 'fake' END, name FROM reg WHERE path IN ('repo/src1','repo/src2')""")
def _(spark, sf):
    reg = registry(spark, sf)
    gates = reg.select(
        F.col("path").alias("gate"), F.lit("test").alias("dest"),
        (~F.col("path").isin("repo/src1", "repo/src2")).alias("include"),
        F.when(F.col("media_type") == "real", "real").otherwise("fake").alias("side"), "name")
    return M.gated_holdouts(holdouts(spark, sf), gates)


URLS = """p AS (SELECT page_id, regexp_extract(url,'/([a-z]{2})/',1) type, concat('page-',page_id) name, url FROM pages),
 n AS (SELECT *, regexp_replace(rtrim(lower(url),'/'),'^.*?://','') u FROM p),
 pr AS (SELECT DISTINCT type, regexp_replace(rtrim(lower(CASE WHEN page_id%2=0 THEN url ELSE regexp_extract(url,'^(.*)/[^/]*$',1) END),'/'),'^.*?://','') u FROM p WHERE page_id%3=0),
 tr AS (SELECT * FROM n WHERE page_id%3<>0)"""


@query("origin_overlap", f"""WITH {URLS} SELECT DISTINCT t.type, t.name, t.u train_url FROM tr t JOIN pr p ON t.type=p.type
 AND (t.u=p.u OR starts_with(t.u,concat(p.u,'/')) OR starts_with(p.u,concat(t.u,'/'))) WHERE p.u<>'' AND t.u<>''""")
def _(spark, sf):
    p = B.table(spark, sf, "pages").select(
        F.col("page_id"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("type"),
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), F.col("url").alias("source_url"))
    up = F.when(F.col("page_id") % 2 == 0, F.col("source_url")).otherwise(F.regexp_extract("source_url", "^(.*)/[^/]*$", 1))
    probes = p.filter("page_id % 3 = 0").withColumn("source_url", up)
    return M.origin_overlap(probes, p.filter("page_id % 3 <> 0"))


@query("normal_urls", "SELECT page_id, regexp_replace(rtrim(lower(url),'/'),'^.*?://','') url FROM pages")
def _(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", S.normal_url(F.col("url")).alias("url"))


@query("disjoint_origins", """SELECT source name, 'shared' status FROM (SELECT DISTINCT source FROM documents WHERE lang='es')
 SEMI JOIN (SELECT DISTINCT source FROM documents WHERE lang<>'es') USING (source)""")
def _(spark, sf):
    d = B.table(spark, sf, "documents").select("lang", F.col("source").alias("name"))
    probes, train = d.filter("lang = 'es'").select("name"), d.filter("lang <> 'es'").select("name")
    return I.isolation_violations(probes, train).withColumn("status", F.lit("shared"))


@query("isolation_violations", "SELECT DISTINCT concat('probe-',doc_id%50) name FROM documents SEMI JOIN labels USING (doc_id)")
def _(spark, sf):
    name = F.concat(F.lit("probe-"), (F.col("doc_id") % 50).cast("string")).alias("name")
    return I.isolation_violations(B.table(spark, sf, "documents").select(name), B.table(spark, sf, "labels").select(name))


CAND = """c AS (SELECT page_id, CASE page_id%4 WHEN 0 THEN 'probe' WHEN 1 THEN 'train' WHEN 2 THEN 'other' ELSE 'train' END AS role,
 CASE WHEN page_id%4=0 THEN concat('probe-',page_id) WHEN page_id%4=1 THEN concat('local-',page_id) ELSE concat('x-',page_id) END AS name,
 CASE page_id%3 WHEN 0 THEN 'real' WHEN 1 THEN 'fake' ELSE 'odd' END AS label,
 CASE WHEN page_id%5=0 THEN NULL ELSE url END AS source_url,
 CASE WHEN page_id%6=0 THEN '2023-05' WHEN page_id%6=1 THEN 'soon' ELSE '2021-07' END AS collected FROM pages)"""


@query("ingest_validation", f"""WITH {CAND} SELECT page_id, 'error' AS severity, 'role' AS reason FROM c WHERE role NOT IN ('probe','train')
 UNION ALL SELECT page_id,'error','prefix' FROM c WHERE (role='probe' AND NOT starts_with(name,'probe-')) OR (role='train' AND NOT starts_with(name,'local-'))
 UNION ALL SELECT page_id,'error','label' FROM c WHERE label NOT IN ('real','fake','semisynthetic')
 UNION ALL SELECT page_id,'error','provenance' FROM c WHERE label='real' AND (source_url IS NULL OR collected IS NULL)
 UNION ALL SELECT page_id,'error','date' FROM c WHERE label='real' AND source_url IS NOT NULL AND collected='soon'
 UNION ALL SELECT page_id,'warn','recent' FROM c WHERE label='real' AND source_url IS NOT NULL AND collected='2023-05'""")
def _(spark, sf):
    k = F.col("page_id")
    p = B.table(spark, sf, "pages").select(
        k, F.when(k % 4 == 0, "probe").when(k % 4 == 2, "other").otherwise("train").alias("role"),
        F.concat(F.when(k % 4 == 0, "probe-").when(k % 4 == 1, "local-").otherwise("x-"), k.cast("string")).alias("name"),
        F.when(k % 3 == 0, "real").when(k % 3 == 1, "fake").otherwise("odd").alias("label"),
        F.when(k % 5 != 0, F.col("url")).alias("source_url"),
        F.when(k % 6 == 0, "2023-05").when(k % 6 == 1, "soon").otherwise("2021-07").alias("collected_before"))
    return I.validate_candidates(p).select("page_id", "severity", "reason")


@query("leak_scan", """SELECT event_id, event_type model_name, CASE WHEN value<50 THEN 'live' ELSE 'gone' END status FROM events WHERE regexp_matches(event_type,'PURCH|err','i')""")
def _(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", F.col("event_type").alias("model_name"), "value",
                                            F.concat(F.lit("f/"), F.col("event_id").cast("string")).alias("path"))
    listing = e.filter("value < 50").select("path")
    return I.leak_scan(e, listing, "PURCH|err").select("event_id", "model_name", "status")


@query("type_prior_share", "WITH " + RAW + """, d AS (SELECT DISTINCT dataset, kind FROM raw WHERE label=1)
 SELECT round(avg(CASE WHEN kind='semisynthetic' THEN 1.0 ELSE 0.0 END),6) semi_share, count(*) fake_datasets FROM d""")
def _(spark, sf):
    d = B.raw_manifest(spark, sf).filter("label = 1").groupBy("dataset").agg(F.min("kind").alias("kind"))
    return d.agg(F.round(F.avg((F.col("kind") == "semisynthetic").cast("double")), 6).alias("semi_share"),
                 F.count(F.lit(1)).alias("fake_datasets"))


NUM = ("width", "height", "min_side", "max_side", "aspect", "megapixels", "bytes_per_pixel", "file_bytes", "m_eval")
CATS = ("ext", "file_format", "pil_mode", "generator_family")
_TOP = " UNION ALL ".join(f"SELECT '{c}' feature, {c} AS val FROM m" for c in CATS)


@query("metadata_features", "WITH " + MANIFEST + f""", v AS (SELECT feature, val, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, val) p FROM ({_TOP}) GROUP BY 1,2),
 t AS (SELECT concat(feature,'=',val) k FROM v WHERE p<=3),
 h AS (SELECT image_id, list_sort(list(k)) hot FROM (SELECT image_id, unnest([{",".join(f"concat('{c}=',{c})" for c in CATS)}]) k FROM m) JOIN t USING (k) GROUP BY 1)
 SELECT m.image_id, {", ".join(f"round(ln(1+CAST({c} AS DOUBLE)),6) log1p_{c}" for c in NUM)}, array_to_string(hot,',') hot FROM m JOIN h ON m.image_id=h.image_id""")
def _(spark, sf):
    f = M.metadata_features(B.manifest(spark, sf), NUM, CATS, top_k=3)
    return f.select("image_id", *[r6(f"log1p_{c}") for c in NUM], F.array_join("hot", ",").alias("hot"))


@query("top_values", "WITH " + MANIFEST + f" SELECT feature, val AS value, n, p place FROM (SELECT feature, val, count(*) n, CAST(row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, val) AS INT) p FROM ({_TOP}) GROUP BY 1,2) WHERE p<=2")
def _(spark, sf):
    return R.top_values(B.manifest(spark, sf), CATS, 2)


# ---- joins --------------------------------------------------------------------------------------

def build_inputs(spark, sf):
    m = B.raw_manifest(spark, sf)
    meta = m.select("dataset", F.lit("").alias("iso_week"),
                    F.concat(F.lit("img_"), S.padded(F.col("doc_id"), 6), F.lit("."), F.col("ext")).alias("file"),
                    F.col("image_id").alias("path"), "source_file")
    files = m.filter("width >= 200").select(F.col("image_id").alias("path"), "width", "height", "file_format", "pil_mode", "file_bytes")
    reg = registry(spark, sf).filter("name <> 'src3-fr'").withColumn("source_format", F.lit("zip")).withColumn(
        "generator_family", F.lit(None).cast("string")).withColumn("generator_variant", F.lit(None).cast("string"))
    return meta, reg, files


@query("manifest_build", "WITH " + RAW + f"""{REGISTRY}, dim AS (SELECT name, CASE WHEN media_type='real' THEN 0 ELSE 1 END label,
  CASE WHEN media_type='real' THEN 'real' WHEN name='src1-fr' OR media_type='semisynthetic' THEN 'semisynthetic' ELSE 'synthetic' END kind,
  CASE name WHEN 'src1-en' THEN 'aerial' ELSE content_category END fx, path,
  CASE WHEN name IN ('src1-en','src2-en') THEN 'src1-en' ELSE name END release FROM reg WHERE name<>'src3-fr'),
 fo AS (SELECT fx, count(DISTINCT label) k FROM dim GROUP BY 1)
 SELECT concat(dataset,'/img_',lpad(CAST(doc_id AS VARCHAR),CAST(greatest(length(CAST(doc_id AS VARCHAR)),6) AS INT),'0'),'.',ext) image_id, dataset, dim.label, dim.kind, dim.fx content_category_fixed,
  CASE WHEN k<2 THEN 'diverse' ELSE dim.fx END category, release, path source_path, source_file, file_index, ext, min_side,
  round(CAST(512 AS DOUBLE)/min_side,6) m_eval
 FROM raw JOIN dim ON dataset=name JOIN fo USING (fx) WHERE width>=200""")
def _(spark, sf):
    meta, reg, files = build_inputs(spark, sf)
    shards = rows(spark, "a|0|src1-en;a|1|src2-en", "shard_id string, pos string, name string")
    m = M.build(meta, reg, files, fixes=rows(spark, "src1-en|aerial", "name string, fix string"),
                listed=MD.name_list(spark, ["src1-fr"]), shards=shards)
    return m.select("image_id", "dataset", "label", "kind", "content_category_fixed", "category",
                    F.col("group").alias("release"), "source_path", "source_file", "file_index", "ext", "min_side", r6("m_eval"))


@query("registry_rows", "WITH " + RAW + REGISTRY + " SELECT image_id, media_type, path FROM raw JOIN reg ON dataset=name WHERE path<>'repo/src4'")
def _(spark, sf):
    reg = registry(spark, sf).filter("path <> 'repo/src4'").withColumnRenamed("name", "dataset")
    return B.raw_manifest(spark, sf).select("image_id", "dataset").join(reg, "dataset").select("image_id", "media_type", "path")


@query("probe_join", "WITH " + RAW + " SELECT image_id, n_chars, width FROM raw JOIN documents USING (doc_id)")
def _(spark, sf):
    probe = B.table(spark, sf, "documents").select("doc_id", "n_chars")
    return B.raw_manifest(spark, sf).join(probe, "doc_id").select("image_id", "n_chars", "width")


@query("registry_coverage", "WITH " + RAW + REGISTRY + """ SELECT name, 'unknown' status FROM reg WHERE path='repo/src1'
 UNION ALL SELECT DISTINCT concat('ghost-',source), 'missing' FROM documents""")
def _(spark, sf):
    reg = registry(spark, sf)
    ghosts = B.table(spark, sf, "documents").select(F.concat(F.lit("ghost-"), F.col("source")).alias("name")).distinct()
    return M.coverage(reg.filter("path <> 'repo/src1'").select("name").unionByName(ghosts), reg)


@query("holdout_coverage", "WITH " + RAW + HOLD + """ SELECT split, name, CASE WHEN a AND b THEN 'disk/manifest' WHEN a THEN 'disk' ELSE 'manifest' END missing_where
 FROM (SELECT split, name, ends_with(name,'-fr') a, ends_with(name,'-fr') OR ends_with(name,'-de') b FROM hold) WHERE a OR b""")
def _(spark, sf):
    reg = registry(spark, sf)
    return M.holdout_coverage(holdouts(spark, sf), reg.filter("name not like '%-fr'"),
                              reg.filter("name not like '%-fr' and name not like '%-de'"))


@query("missing_mates", "WITH " + RAW + HOLD + """, there AS (SELECT name FROM reg WHERE name NOT LIKE '%-fr')
 SELECT DISTINCT h.split, h.name, b.name mate FROM hold h JOIN there USING (name) JOIN reg a ON a.name=h.name JOIN reg b ON b.path=a.path AND b.name<>a.name
 WHERE b.name NOT IN (SELECT name FROM there)""")
def _(spark, sf):
    reg = registry(spark, sf)
    cliques = reg.select(F.col("path").alias("clique_id"), "name")
    return M.missing_mates(holdouts(spark, sf), cliques, reg.filter("name not like '%-fr'"))


@query("dataset_columns", "WITH " + RAW + " SELECT DISTINCT dataset, label, kind, source_path FROM raw")
def _(spark, sf):
    return B.raw_manifest(spark, sf).select("dataset", "label", "kind", "source_path").dropDuplicates(["dataset"])


# ---- reports ------------------------------------------------------------------------------------

@query("category_label_pivot", "WITH " + MANIFEST + """ SELECT category, count(*) FILTER (WHERE label=0) real_rows, count(*) FILTER (WHERE label=1) fake_rows,
 count(DISTINCT dataset) FILTER (WHERE label=0) real_datasets, count(DISTINCT dataset) FILTER (WHERE label=1) fake_datasets,
 round(avg(label),6) p_fake, min(label)=max(label) single_label FROM m GROUP BY 1""")
def _(spark, sf):
    return M.category_label_pivot(B.manifest(spark, sf)).withColumn("p_fake", F.round("p_fake", 6))


def _qs(col):
    return ", ".join(f"round({quantile(col, p)},6) {n}" for n, p in
                     (("p05", .05), ("p25", .25), ("p50", .5), ("p75", .75), ("p95", .95)))


@query("side_quantiles", "WITH " + MANIFEST + f" SELECT label, {_qs('min_side')}, round(avg(min_side),6) mean, round(avg(CASE WHEN m_eval>1 THEN 1.0 ELSE 0.0 END),6) upsampled FROM m GROUP BY 1")
def _(spark, sf):
    q = M.side_quantiles(B.manifest(spark, sf), "min_side")
    return q.select("label", *[r6(c) for c in ("p05", "p25", "p50", "p75", "p95", "mean", "upsampled")])


@query("resample_quantiles", "WITH " + MANIFEST + f" SELECT label, {_qs('m_eval')}, round(avg(m_eval),6) mean, round(avg(CASE WHEN m_eval>1 THEN 1.0 ELSE 0.0 END),6) upsampled FROM m GROUP BY 1")
def _(spark, sf):
    q = M.side_quantiles(B.manifest(spark, sf), "m_eval")
    return q.select("label", *[r6(c) for c in ("p05", "p25", "p50", "p75", "p95", "mean", "upsampled")])


@query("resample_bins", "WITH " + MANIFEST + f""", e AS (SELECT {quantile('m_eval', .01)} lo, {quantile('m_eval', .99)} hi FROM m),
 b AS (SELECT CAST(least(greatest(floor(12*ln(m_eval/lo)/ln(hi/lo)),0),11) AS INT) bin, label FROM m, e)
 SELECT bin, count(*) FILTER (WHERE label=0) AS "real", count(*) FILTER (WHERE label=1) fake,
 count(*) FILTER (WHERE label=0)>=50 AND count(*) FILTER (WHERE label=1)>=50 AS "both", round(count(*)/(SELECT count(*) FROM m),6) mass FROM b GROUP BY 1""")
def _(spark, sf):
    return M.resample_bins(B.manifest(spark, sf)).withColumn("mass", F.round("mass", 6))


@query("format_shares", "WITH " + MANIFEST + " SELECT label, ext, count(*) n, round(count(*)/sum(count(*)) OVER (PARTITION BY label),6) share FROM m GROUP BY 1,2")
def _(spark, sf):
    return M.shares(B.manifest(spark, sf), "ext").withColumn("share", F.round("share", 6))


@query("category_joint_shares", "WITH " + MANIFEST + " SELECT category, count(*) n, round(count(*)/sum(count(*)) OVER (),6) share FROM m GROUP BY 1")
def _(spark, sf):
    return M.shares(B.manifest(spark, sf), "category", by=None).withColumn("share", F.round("share", 6))


@query("dataset_size_range", "WITH " + RAW + " SELECT min(n) min_rows, median(CAST(n AS DOUBLE)) median_rows, max(n) max_rows FROM (SELECT dataset, count(*) n FROM raw GROUP BY 1)")
def _(spark, sf):
    return M.dataset_size_range(B.raw_manifest(spark, sf))


@query("count_floors", "WITH " + RAW + " SELECT dataset, count(*) AS rows, CAST(CASE WHEN dataset='src0-en' THEN 800 ELSE 12 END AS BIGINT) AS floor FROM raw GROUP BY 1 HAVING count(*)<CASE WHEN dataset='src0-en' THEN 800 ELSE 12 END")
def _(spark, sf):
    return M.count_floors(B.raw_manifest(spark, sf), 15, 0.2, {"src0-en": 1000})


@query("format_gaps", "WITH " + MANIFEST + """, u AS (SELECT 'generator_family' AS feature, generator_family AS value, label FROM m UNION ALL SELECT 'pil_mode', pil_mode, label FROM m UNION ALL SELECT 'file_format', file_format, label FROM m),
 g AS (SELECT feature, value, count(*) FILTER (WHERE label=0) r, count(*) FILTER (WHERE label=1) f FROM u GROUP BY 1,2),
 h AS (SELECT *, r/sum(r) OVER (PARTITION BY feature) rs, f/sum(f) OVER (PARTITION BY feature) fs FROM g)
 SELECT feature, value, round(rs,6) real_share, round(fs,6) fake_share, round(abs(rs-fs),6) gap FROM h WHERE abs(rs-fs)>0.2""")
def _(spark, sf):
    g = M.share_gaps(B.manifest(spark, sf), ["generator_family", "pil_mode", "file_format"], over=0.2)
    return g.select("feature", "value", r6("real_share"), r6("fake_share"), r6("gap"))


def _quart(c):
    return f"SELECT label, round({quantile(c, .25)},6) q25, round({quantile(c, .5)},6) q50, round({quantile(c, .75)},6) q75, '{c}' AS feature FROM m GROUP BY 1"


@query("label_quartiles", "WITH " + MANIFEST + " " + _quart("bytes_per_pixel") + " UNION ALL " + _quart("m_eval"))
def _(spark, sf):
    q = M.label_quartiles(B.manifest(spark, sf), ["bytes_per_pixel", "m_eval"])
    return q.select("label", r6("q25"), r6("q50"), r6("q75"), "feature")


@query("extreme_medians", "WITH " + MANIFEST + f""" SELECT dataset, round(md,6) median_m FROM (SELECT dataset, {quantile('m_eval', .5)} md FROM m GROUP BY 1)
 WHERE md>1.2 OR md<0.5 ORDER BY round(abs(ln(md)),9) DESC, dataset LIMIT 12""")
def _(spark, sf):
    return M.extreme_medians(B.manifest(spark, sf), high=1.2, low=0.5).select("dataset", r6("median_m"))


@query("distinct_counts", "WITH " + MANIFEST + " SELECT category, count(DISTINCT dataset) n_dataset, count(DISTINCT source_file) n_source_file FROM m GROUP BY 1")
def _(spark, sf):
    return M.distinct_counts(B.manifest(spark, sf), ["dataset", "source_file"], ["category"])


# ---- sketches -----------------------------------------------------------------------------------

def sketched(spark, sf):
    """Cells of supplier, line status and month of the order lines, with sketches of orders, prices and parts."""
    r = B.table(spark, sf, "lineitem").select("l_suppkey", "l_linestatus", F.date_trunc("month", "l_shipdate").alias("month"), "l_orderkey", "l_partkey", "l_extendedprice")
    return K.sketch_table(r, ["l_suppkey", "l_linestatus", "month"], {"orders": F.col("l_orderkey")}, {"price": F.col("l_extendedprice")}, {"parts": F.col("l_partkey")})


@query("sketched_distinct", "SELECT l_linestatus, count(*) AS \"rows\", count(DISTINCT l_orderkey) orders, true within_bound FROM lineitem GROUP BY 1")
def _(spark, sf):
    """Distinct orders by line status from the sketches, beside the exact number and whether the bound holds."""
    e = K.distinct_estimates(sketched(spark, sf), ["l_linestatus"], "orders")
    x = B.table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.count_distinct("l_orderkey").alias("orders"))
    near = F.abs(F.col("estimate") - F.col("orders")) <= F.greatest(F.lit(1.0), F.col("orders") * K.DISTINCT_BOUND)
    return e.join(x, "l_linestatus").select("l_linestatus", "rows", "orders", near.alias("within_bound"))


@query("sketched_quantiles", "SELECT l_linestatus, CAST(p AS DOUBLE) AS prob, true within_bound FROM (SELECT DISTINCT l_linestatus FROM lineitem), (SELECT unnest([0.05,0.25,0.5,0.75,0.95]) p)")
def _(spark, sf):
    """Quantiles of prices by line status from the sketches, judged by the exact share of rows below them."""
    e = K.quantile_estimates(sketched(spark, sf), ["l_linestatus"], "price", [0.05, 0.25, 0.5, 0.75, 0.95])
    asked = e.groupBy("l_linestatus").agg(F.collect_list(F.struct("prob", "value")).alias("asked"))  # five numbers a status
    r = B.table(spark, sf, "lineitem").select("l_linestatus", F.col("l_extendedprice").cast("double").alias("v"))
    r = r.join(F.broadcast(asked), "l_linestatus").select("l_linestatus", "v", F.explode("asked").alias("a"))  # a row for each status
    share = r.groupBy("l_linestatus", F.col("a.prob").alias("prob")).agg(F.avg((F.col("v") < F.col("a.value")).cast("double")).alias("below"),
                                                                        F.avg((F.col("v") <= F.col("a.value")).cast("double")).alias("upto"))
    near = (F.col("below") <= F.col("prob") + K.RANK_BOUND) & (F.col("upto") >= F.col("prob") - K.RANK_BOUND)
    return share.select("l_linestatus", "prob", near.alias("within_bound"))


@query("sketched_overlap", """WITH s AS (SELECT DISTINCT l_linestatus, l_suppkey%2 odd, l_partkey FROM lineitem), a AS (SELECT l_linestatus, l_partkey, bool_or(odd=0) l, bool_or(odd=1) r FROM s GROUP BY 1,2)
 SELECT l_linestatus, count(*) FILTER (WHERE l AND r) AS both_sides, count(*) either_side, true within_bound FROM a GROUP BY 1""")
def _(spark, sf):
    """Parts that suppliers with even and with odd numbers share, by line status, from the sketches beside the exact numbers."""
    side = F.when(F.col("l_suppkey") % 2 == 0, "left").otherwise("right")
    e = K.shared_estimates(sketched(spark, sf), side, ["l_linestatus"], "parts")
    x = B.table(spark, sf, "lineitem").groupBy("l_linestatus", "l_partkey").agg(F.max((F.col("l_suppkey") % 2 == 0).cast("int")).alias("l"), F.max((F.col("l_suppkey") % 2).cast("int")).alias("r"))
    x = x.groupBy("l_linestatus").agg(F.sum(F.col("l") * F.col("r")).alias("both_sides"), F.count(F.lit(1)).alias("either_side"))
    bound = F.greatest(F.lit(1.0), F.col("either_side") * K.SET_BOUND)
    near = (F.abs(F.col("both") - F.col("both_sides")) <= bound) & (F.abs(F.col("either") - F.col("either_side")) <= bound)
    return e.join(x, "l_linestatus").select("l_linestatus", "both_sides", "either_side", near.alias("within_bound"))
