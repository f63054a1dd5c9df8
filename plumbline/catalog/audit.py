"""Queries of the shortcut audit, the ledger and the probe suite."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.functions import ranking as R
from plumbline.functions import scalar as S
from plumbline.operators import audit as A
from plumbline.operators import boosting as T
from plumbline.operators import ingest as I
from plumbline.operators import ledger as L
from plumbline.operators import modes as MO
from plumbline.operators import pixels as P
from plumbline.operators import sampling as W
from plumbline.sources import metadata as MD
from plumbline.catalog.base import r6, registrar
from plumbline.catalog import evaluation as EV
from plumbline.catalog.evaluation import auc_sql, fused_manifest, fused_scored, rho_sql
from plumbline.catalog.sqltext import MANIFEST, SCORED_MANIFEST, SPLIT, frac, fused, sigmoid

Q, SQL, query = registrar()

WEEK = "concat(isoyear(ts),'W',lpad(CAST(week(ts) AS VARCHAR),2,'0'))"


@query("generator_census", f"SELECT {WEEK} AS week, event_type AS model_name, count(*) n FROM events GROUP BY 1,2")
def _(spark, sf):
    return I.generator_census(B.table(spark, sf, "events"), MD.iso_week(F.col("ts")), "event_type")


ENC = " UNION ALL ".join(f"SELECT '{c}' feature, {c} AS value, label FROM m" for c in ("ext", "pil_mode", "generator_family"))


@query("target_encoding", "WITH " + MANIFEST + f" SELECT feature, value, round(avg(label),6) lift, count(*) n FROM ({ENC}) GROUP BY 1,2")
def _(spark, sf):
    t = A.target_encode(B.raw_manifest(spark, sf), ["ext", "pil_mode", "generator_family"])
    return t.select("feature", "value", r6("lift"), "n")


NUM = ("width", "min_side", "bytes_per_pixel", "m_eval")
FEATS = (" UNION ALL ".join(f"SELECT '{c}' feature, CAST({c} AS DOUBLE) AS score, label FROM m" for c in NUM) + " UNION ALL "
         + " UNION ALL ".join(f"SELECT '{c}', avg(label) OVER (PARTITION BY {c}), label FROM m" for c in ("ext", "file_format", "pil_mode")))


@query("feature_aucs", "WITH " + MANIFEST + f", u AS ({FEATS})" + " SELECT feature, n, round(greatest(auc,1-auc),6) auc, CASE WHEN greatest(auc,1-auc)>0.65 THEN 'warn' ELSE 'ok' END verdict FROM " + auc_sql("u", ["feature"], "score", "label"))
def _(spark, sf):
    m = B.raw_manifest(spark, sf)
    return A.feature_aucs(m, NUM, ("ext", "file_format", "pil_mode")).select("feature", "n", r6("auc"), "verdict")


# ---- probes by model ----------------------------------------------------------------------------

#: Trees of the queries' probes: fewer and shorter than the operators' default.
TREES = T.Shape(rounds=10, depth=3, step=0.4)
META_CATEGORIES = ("ext", "file_format", "pil_mode")


def _probed(spark, sf, *only):
    """All probes of the metadata mode, or those named; categories as recorded against categories corrected by rule for two datasets."""
    fixed = F.when(F.col("dataset").isin("src1-es", "src6-es"), "c1").otherwise(F.col("content_category"))
    m = B.split_manifest(spark, sf).withColumn("content_category_fixed", fixed)
    return MO.metadata_probes(m, A.NUMERIC, META_CATEGORIES, seed=B.SEED, shape=TREES, only=only)


@query("metadata_probe")
def _(spark, sf):
    v = A.probe_results(_probed(spark, sf, "blocked"), {"blocked": "label"})
    return v.select("n", r6("auc"), r6("coverage"), r6("ceiling"), "unmeasurable", A.probe_bucket("metadata_auc").alias("verdict"))


def _auc_pair(scored, first, second):
    v = A.probe_results(scored, {first: "label", second: "label"})
    of = lambda k: F.max(F.when(F.col("probe") == k, F.col("auc")))
    return v.agg(of(first).alias("a"), of(second).alias("b"))


@query("blocking_gap")
def _(spark, sf):
    g = _auc_pair(_probed(spark, sf, "blocked", "naive"), "blocked", "naive")
    return g.select(r6("a", "auc_blocked"), r6("b", "auc_naive"), r6(F.col("b") - F.col("a"), "gap"))


@query("override_efficacy")
def _(spark, sf):
    g = _auc_pair(_probed(spark, sf, "raw", "fixed"), "raw", "fixed")
    return g.select(r6("a", "auc_raw"), r6("b", "auc_fixed"), r6(F.col("b") - F.col("a"), "delta"))


@query("val_inheritance")
def _(spark, sf):
    rows = MO.metadata_probe_rows(_probed(spark, sf, "blocked", "val")).filter("test = 'M4_val_inheritance'")
    return rows.select("split", "n", r6(F.col("metrics.auc_val"), "auc"), r6("value", "excess"), "verdict")


@query("audit_probe_rows")
def _(spark, sf):
    return mode_rows(MO.metadata_probe_rows(_probed(spark, sf)))


@query("error_predictability")
def _(spark, sf):
    m = fused_manifest(spark, sf)
    v = A.probe_results(MO.error_probe(m, A.NUMERIC, META_CATEGORIES, shape=TREES), {"wrong": "wrong"})
    return v.select(r6("auc"), r6("coverage"), "unmeasurable", A.probe_bucket("error_pred_auc").alias("verdict"))


SPLITS = ("train", "val_id", "val_xgen", "val_stress", "test")


@query("audit_error_rows")
def _(spark, sf):
    scored = MO.error_probe(fused_manifest(spark, sf), A.NUMERIC, META_CATEGORIES, splits=SPLITS, shape=TREES)
    return mode_rows(MO.error_rows(scored, SPLITS))


_HIST = " UNION ALL ".join(f"SELECT '{c}' feature, CAST({c} AS DOUBLE) v, label, file_index%5 fold FROM m" for c in NUM)


@query("probe_histograms", "WITH " + MANIFEST + f", u AS ({_HIST}), b AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v)-1 below, count(*) OVER (PARTITION BY feature) total FROM u)"
       + """, k AS (SELECT *, dense_rank() OVER (PARTITION BY feature ORDER BY CAST(floor(below*255/total) AS BIGINT)) bin FROM b)
 SELECT 'label' model, f.fold, feature, bin, count(*) n, CAST(sum(label) AS BIGINT) positives FROM k JOIN (SELECT unnest(range(5)) fold) f ON k.fold<>f.fold GROUP BY ALL""")
def _(spark, sf):
    """What the probes of five folds see before their first cut: the rows of all other folds by feature and bin."""
    m = B.raw_manifest(spark, sf)
    groups = {"label": T.Group(F.col("label"), F.col("file_index") % 5, NUM)}
    return T.first_histograms(m, {c: F.col(c) for c in NUM}, groups, ["image_id"])


# ---- slices -------------------------------------------------------------------------------------

_NUIS = " UNION ALL ".join(
    f"SELECT split, '{f}' flag, ({c})::INT AS on_, '{b}' branch, {m} ms FROM sf WHERE label=0"
    for f, c in (("is_png", "file_format='PNG'"), ("non_rgb", "pil_mode<>'RGB'"), ("upsampled", "m_eval>1"))
    for b, m in (("fused", "d"), ("branch_0", "d1"), ("branch_1", "d2"), ("branch_2", "d3")))


@query("nuisance_aucs", "WITH " + SCORED_MANIFEST + f", nu AS ({_NUIS}), a AS (SELECT * FROM " + auc_sql("nu", ["split", "flag", "branch"], "ms", "on_") + """)
 SELECT split, flag, branch, n, round(greatest(auc,1-auc),6) auc, CASE WHEN branch='fused' THEN CASE WHEN greatest(auc,1-auc)>0.75 THEN 'hard' WHEN greatest(auc,1-auc)>0.65 THEN 'warn' ELSE 'ok' END END verdict FROM a WHERE n>30 AND auc IS NOT NULL""")
def _(spark, sf):
    flags = {"is_png": F.upper("file_format") == "PNG", "non_rgb": F.col("pil_mode") != "RGB", "upsampled": F.col("m_eval") > 1}
    a = A.nuisance_aucs(fused_manifest(spark, sf), flags, floor=30)
    return a.select("split", "flag", "branch", "n", r6("auc"), "verdict")


_BR = " UNION ALL ".join(f"SELECT label, {i} branch, d{i + 1} ms, m_eval FROM sf" for i in range(3))


@query("branch_rhos", "WITH " + SCORED_MANIFEST + f", br AS ({_BR}) SELECT label, branch, n, round(rho,6) rho FROM " + rho_sql("br", ["label", "branch"], "ms", "m_eval"))
def _(spark, sf):
    r = A.branch_rhos(B.scored_manifest(spark, sf), ["label"], "m_eval")
    return r.select("label", "branch", "n", r6("rho"))


ACC = "avg(CASE WHEN (d>0)=(label=1) THEN CAST(1 AS DOUBLE) ELSE 0 END) FILTER (WHERE kind='{k}')"


@query("kind_deficit", "WITH " + SCORED_MANIFEST + f", k AS (SELECT split, {ACC.format(k='real')} a, {ACC.format(k='synthetic')} b, {ACC.format(k='semisynthetic')} c FROM sf GROUP BY 1)"
       + " SELECT split, round(a,6) acc_real, round(b,6) acc_synthetic, round(c,6) acc_semisynthetic, round(b-c,6) deficit, CASE WHEN b-c>0.15 THEN 'warn' ELSE 'ok' END verdict FROM k")
def _(spark, sf):
    k = A.kind_deficit(fused_manifest(spark, sf))
    return k.select("split", r6("acc_real"), r6("acc_synthetic"), r6("acc_semisynthetic"), r6("deficit"), "verdict")


# ---- pairs --------------------------------------------------------------------------------------

# Sources with odd numbers publish all their datasets as one unit; those with even numbers each as its own.
PAIRS = "WITH " + SCORED_MANIFEST + """, pu AS (SELECT * REPLACE (CASE WHEN CAST(substring(source_path,9) AS INT)%2=1 THEN split_unit ELSE concat(source_path,'/',dataset) END AS split_unit) FROM sf),
 mx AS (SELECT split_unit FROM pu GROUP BY 1 HAVING count(DISTINCT label)=2),
 pr AS (SELECT pu.*, pu.split_unit IN (SELECT split_unit FROM mx) in_pair FROM pu),
 un AS (SELECT split_unit, count(*) n, count(*) FILTER (WHERE label=0) nr, count(*) FILTER (WHERE label=1) nf, avg(d) FILTER (WHERE label=1)-avg(d) FILTER (WHERE label=0) gap,
  avg((d<=0)::INT) FILTER (WHERE label=0) ar, avg((d>0)::INT) FILTER (WHERE label=1) af, avg((d>0)::INT) FILTER (WHERE label=0) fpr,
  avg((file_format='PNG')::INT) FILTER (WHERE label=1)-avg((file_format='PNG')::INT) FILTER (WHERE label=0) pd,
  ln(greatest(quantile_cont(CAST(min_side AS DOUBLE),0.5) FILTER (WHERE label=1),1)/greatest(quantile_cont(CAST(min_side AS DOUBLE),0.5) FILTER (WHERE label=0),1)) lr FROM pr WHERE in_pair GROUP BY 1),
 uu AS (SELECT * FROM un WHERE nr>0 AND nf>0)"""


def paired(spark, sf):
    own = F.concat_ws("/", "source_path", "dataset")
    unit = F.when(F.substring("source_path", 9, 9).cast("int") % 2 == 1, F.col("split_unit")).otherwise(own)
    return MO.pair_sides(fused_manifest(spark, sf).withColumn("split_unit", unit))


@query("pair_units", PAIRS + " SELECT split_unit, n, nr n_real, nf n_fake, round(gap,6) margin_gap, round(ar,6) acc_real, round(af,6) acc_fake, round(fpr,6) real_fpr, round(pd,6) png_delta, round(lr,6) log_res_ratio FROM uu")
def _(spark, sf):
    u = A.pair_units(paired(spark, sf))
    return u.select("split_unit", "n", "n_real", "n_fake", *[r6(c) for c in ("margin_gap", "acc_real", "acc_fake", "real_fpr", "png_delta", "log_res_ratio")])


DROP = ", dr AS (SELECT avg((d>0)::INT) FILTER (WHERE in_pair AND label=1) i, avg((d>0)::INT) FILTER (WHERE NOT in_pair AND label=1) o, avg((d>0)::INT) FILTER (WHERE NOT in_pair AND label=0) g FROM pr)"


@query("pair_drop", PAIRS + DROP + " SELECT round(i,6) acc_in, round(o,6) acc_out, round(g,6) global_fpr, round(o-i,6) AS drop, CASE WHEN o-i>0.15 THEN 'warn' ELSE 'ok' END verdict FROM dr")
def _(spark, sf):
    return A.pair_drop(paired(spark, sf)).select(r6("acc_in"), r6("acc_out"), r6("global_fpr"), r6("drop"), "verdict")


@query("pair_confounds", PAIRS + ", cf AS (SELECT 'png_delta' against, pd x, gap FROM uu UNION ALL SELECT 'log_res_ratio', lr, gap FROM uu) SELECT against, n, round(rho,6) rho, CASE WHEN abs(rho)>0.5 THEN 'warn' ELSE 'ok' END verdict FROM " + rho_sql("(SELECT against, round(x,9) x, round(gap,9) gap FROM cf)", ["against"], "x", "gap"))
def _(spark, sf):
    u = A.pair_units(paired(spark, sf))
    u = u.withColumn("png_delta", F.round("png_delta", 9)).withColumn("log_res_ratio", F.round("log_res_ratio", 9)).withColumn("margin_gap", F.round("margin_gap", 9))
    return A.pair_confounds(u).select("against", "n", r6("rho"), "verdict")


@query("pair_fpr_flags", PAIRS + DROP + " SELECT split_unit, round(fpr,6) real_fpr, nr n_real FROM uu, dr WHERE nr>=20 AND fpr>0.05 AND CASE WHEN g>0 THEN fpr/g>2 ELSE fpr>0 END")
def _(spark, sf):
    p = paired(spark, sf)
    return A.pair_fpr_flags(A.pair_units(p), A.pair_drop(p)).select("split_unit", r6("real_fpr"), "n_real")


# ---- interventions ------------------------------------------------------------------------------

AFTER = f"""{fused()}, {fused('robust', 'rb')}, af AS (SELECT 'other_view' intervention, 'robust' setting, vec_id, d, d1, d2, d3 FROM rb UNION ALL SELECT 'shift', '-0.3', vec_id, d-0.3, d1-0.3, d2-0.3, d3-0.3 FROM sc
 UNION ALL SELECT 'shift', '-0.1', vec_id, d-0.1, d1-0.1, d2-0.1, d3-0.1 FROM sc UNION ALL SELECT 'damp', '0.5', vec_id, d*0.5, d1*0.5, d2*0.5, d3*0.5 FROM sc)"""
JOINED = f", j AS (SELECT intervention, setting, y, sc.d m0, af.d m1, {sigmoid('af.d')}-{sigmoid('sc.d')} dp FROM sc JOIN af USING (vec_id))"


def _flip_cols(v, n):
    f = f"FILTER (WHERE y={v})"
    return (f"avg(((m0>0)=(y=1))::INT) {f} acc_before_{n}, avg(((m1>0)=(y=1))::INT) {f} acc_after_{n}, avg(((m0>0)<>(m1>0))::INT) {f} flip_{n}, avg(dp) {f} dp_{n}, avg(abs(dp)) {f} adp_{n}")


FLIPS = JOINED + f", fl AS (SELECT intervention, setting, count(*) n, {_flip_cols(0, 'real')}, {_flip_cols(1, 'fake')} FROM j GROUP BY 1,2)"
FLIP_COLS = [f"{t}_{n}" for n in ("real", "fake") for t in ("acc_before", "acc_after", "flip", "dp", "adp")]


def interventions(spark, sf):
    b = fused_scored(spark, sf)
    other = fused_scored(spark, sf, "robust").select(F.lit("other_view").alias("intervention"), F.lit("robust").alias("setting"), "vec_id", "margin", "d")
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("intervention"), F.lit(s).alias("setting"), fn(F.col("margin")).alias("margin"), F.transform("d", fn).alias("d"))
                               for n, s, fn in (("shift", "-0.3", lambda x: x - 0.3), ("shift", "-0.1", lambda x: x - 0.1), ("damp", "0.5", lambda x: x * 0.5))]))
    rest = b.select("vec_id", made.alias("s")).select("s.intervention", "s.setting", "vec_id", "s.margin", "s.d")
    return b, other.unionByName(rest)


@query("flip_report", f"WITH {AFTER}{FLIPS} SELECT intervention, setting, n, {', '.join(f'round({c},6) {c}' for c in FLIP_COLS)}, CASE WHEN flip_real>0.25 THEN 'hard' WHEN flip_real>0.1 OR adp_real>0.15 OR (intervention='shift' AND acc_before_fake-acc_after_fake>0.2) THEN 'warn' ELSE 'ok' END verdict FROM fl")
def _(spark, sf):
    b, a = interventions(spark, sf)
    f = A.flip_verdicts(A.flips(b, a, "vec_id"), ["shift"])
    return f.select("intervention", "setting", "n", *[r6(c) for c in FLIP_COLS], "verdict")


_ATTR = " UNION ALL ".join(f"SELECT intervention, setting, {i} branch, sc.d{i + 1} a, af.d{i + 1} b FROM sc JOIN af USING (vec_id) SEMI JOIN pk USING (intervention, setting) WHERE y=0" for i in range(3))


@query("branch_attribution", f"WITH {AFTER}{FLIPS}, pk AS (SELECT intervention, setting FROM fl ORDER BY round(flip_real+adp_real,9) DESC, intervention, setting LIMIT 3), at_ AS ({_ATTR}) SELECT intervention, setting, branch, round(avg(((a>0)<>(b>0))::INT),6) flip_real, round(avg(abs({sigmoid('b')}-{sigmoid('a')})),6) adp_real FROM at_ GROUP BY 1,2,3")
def _(spark, sf):
    b, a = interventions(spark, sf)
    return A.branch_attribution(b, a, "vec_id").select("intervention", "setting", "branch", r6("flip_real"), r6("adp_real"))


@query("text_interventions", """SELECT doc_id, 'lower' intervention, 'all' setting, md5(lower(text)) digest, length(lower(text)) n_chars FROM documents
 UNION ALL SELECT doc_id, 'no_digits', 'all', md5(regexp_replace(text,'[0-9]','','g')), length(regexp_replace(text,'[0-9]','','g')) FROM documents
 UNION ALL SELECT doc_id, 'spaces', 'one', md5(regexp_replace(text,' +',' ','g')), length(regexp_replace(text,' +',' ','g')) FROM documents""")
def _(spark, sf):
    d = A.intervene(B.table(spark, sf, "documents"), "doc_id", "text", A.TEXT_INTERVENTIONS, ["lower", "no_digits", "spaces"])
    return d.select("doc_id", "intervention", "setting", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars"))


@query("repeated_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text,chr(10))) line, generate_subscripts(string_split(text,chr(10)),1) i FROM documents),
 f AS (SELECT doc_id, line, min(i) i FROM l GROUP BY 1,2), j AS (SELECT doc_id, string_agg(line,chr(10) ORDER BY i) t FROM f GROUP BY 1) SELECT doc_id, md5(t) digest FROM j""")
def _(spark, sf):
    d = A.intervene(B.table(spark, sf, "documents"), "doc_id", "text", A.TEXT_INTERVENTIONS, ["repeated_lines"])
    return d.select("doc_id", F.md5("text").alias("digest"))


# ---- ledger -------------------------------------------------------------------------------------

LEDGER = f"""lg AS (SELECT date_trunc('week',ts) ts, concat('slices|value|events|part=',CAST(user_id%5 AS VARCHAR),',type=',event_type) key_str, event_type, user_id%5 part, avg(value)/100 AS value, count(*) n FROM events GROUP BY ALL),
 cur AS (SELECT * FROM lg WHERE ts=(SELECT max(ts) FROM lg)), prev AS (SELECT * FROM lg WHERE ts<(SELECT max(ts) FROM lg) AND NOT (part=0 AND event_type='signup')),
 lt AS (SELECT * FROM prev QUALIFY row_number() OVER (PARTITION BY key_str ORDER BY ts DESC)=1)"""


def ledger(spark, sf, planted=True):
    """(newest week, earlier weeks); with ``planted`` one key family has no earlier rows and is a baseline."""
    e = B.table(spark, sf, "events")
    g = e.groupBy(F.date_trunc("week", "ts").alias("ts"), "event_type", (F.col("user_id") % 5).alias("part")).agg(
        (F.avg("value") / 100).alias("value"), F.count(F.lit(1)).alias("n"))
    key = F.create_map(F.lit("type"), F.col("event_type"), F.lit("part"), F.col("part").cast("string"))
    g = g.withColumn("key_str", L.key_string(F.lit("slices"), F.lit("value"), F.lit("events"), key)).withColumn("seq", F.lit(0))
    g = g.withColumn("headline", F.lit("acc")).withColumn("test", F.lit("value")).withColumn("mode", F.lit("slices"))
    last = g.agg(F.max("ts")).scalar()
    new = (F.col("part") == 0) & (F.col("event_type") == "signup") & F.lit(planted)
    return g.filter(F.col("ts") == last), g.filter((F.col("ts") < last) & ~new)


def whole_ledger(spark, sf):
    """Every week and key of the ledger."""
    cur, prev = ledger(spark, sf, planted=False)
    return cur.unionByName(prev)


@query("latest_ledger", f"WITH {LEDGER} SELECT key_str, ts, round(value,6) AS value, n FROM lg QUALIFY row_number() OVER (PARTITION BY key_str ORDER BY ts DESC)=1")
def _(spark, sf):
    return L.latest(whole_ledger(spark, sf)).select("key_str", "ts", r6("value"), "n")


VERDICT = "CASE WHEN c.value>0.52 THEN 'warn' ELSE 'ok' END"


@query("regression_verdicts", f"WITH {LEDGER}, j AS (SELECT c.key_str, c.value v, c.value-p.value delta, p.key_str IS NULL baseline, {VERDICT} vd FROM cur c LEFT JOIN lt p USING (key_str)) SELECT key_str, round(v,6) AS value, round(delta,6) delta, baseline, vd='ok' AND coalesce(delta<-0.05,FALSE) regressed, CASE WHEN vd='ok' AND delta<-0.05 THEN 'warn' ELSE vd END verdict FROM j")
def _(spark, sf):
    cur, prev = ledger(spark, sf)
    cur = cur.withColumn("verdict", F.when(F.col("value") > 0.52, "warn").otherwise("ok")).withColumn("higher_is_bad", F.lit(False))
    r = L.report_order(L.regress(cur, L.latest(prev)))
    return r.select("key_str", r6("value"), r6("delta"), "baseline", "regressed", "verdict")


@query("threshold_verdicts", f"""WITH {LEDGER}, th AS (SELECT * FROM (VALUES {','.join(f"('{n}',CAST({w} AS DOUBLE),CAST({h if h is not None else 'NULL'} AS DOUBLE))" for n, w, h in L.THRESHOLDS)}) t(threshold,warn,hard))
 SELECT key_str, ts, threshold, CASE WHEN value>hard THEN 'hard' WHEN value>warn THEN 'warn' ELSE 'ok' END verdict FROM lg, th""")
def _(spark, sf):
    tests = [F.struct(F.lit(n).alias("threshold"), L.bucket(F.col("value"), n).alias("verdict")) for n, _, _ in L.THRESHOLDS]
    return whole_ledger(spark, sf).select("key_str", "ts", F.explode(F.array(*tests)).alias("s")).select("key_str", "ts", "s.threshold", "s.verdict")


# ---- probe suite --------------------------------------------------------------------------------

PROBE = f"""{fused()}, {fused('robust', 'rb')}, v AS (SELECT 'deploy' mode, dataset, y, d, d1, d2, d3 FROM sc UNION ALL SELECT 'robust', dataset, y, d, d1, d2, d3 FROM rb),
 cv AS (SELECT concat('type-',substr(dataset,5,1)) type, dataset, mode, count(*) n, avg(((d>0)=(y=1))::INT) acc, avg({sigmoid('d')}) mp, avg(((d1>0)=(y=1))::INT) a0, avg(((d2>0)=(y=1))::INT) a1, avg(((d3>0)=(y=1))::INT) a2 FROM v WHERE dataset LIKE '%-0' OR dataset LIKE '%-1' GROUP BY ALL)"""


def coverage(spark, sf):
    v = fused_scored(spark, sf).unionByName(fused_scored(spark, sf, "robust")).withColumnRenamed("view", "mode")
    probes = v.filter("dataset like '%-0' or dataset like '%-1'").select(F.col("dataset").alias("name")).distinct()
    return A.probe_coverage(v, probes.withColumn("type", F.concat(F.lit("type-"), F.substring("name", 5, 1))))


@query("probe_coverage", f"WITH {PROBE} SELECT type, dataset, mode, n, round(acc,6) acc, round(mp,6) mean_p_fake, round(a0,6) acc_branch_0, round(a1,6) acc_branch_1, round(a2,6) acc_branch_2 FROM cv")
def _(spark, sf):
    c = coverage(spark, sf)
    return c.select("type", "dataset", "mode", "n", *[r6(x) for x in ("acc", "mean_p_fake", "acc_branch_0", "acc_branch_1", "acc_branch_2")])


@query("type_status", f"WITH {PROBE}, ty AS (SELECT DISTINCT concat('type-',CASE WHEN vec_id%50=0 THEN 'none' ELSE CAST(label AS VARCHAR) END) type FROM embeddings), w AS (SELECT type, min(acc) worst FROM cv WHERE mode='deploy' GROUP BY 1) SELECT ty.type, round(worst,6) worst, CASE WHEN worst IS NULL THEN 'untested' WHEN worst<0.8 THEN 'weak' WHEN worst>=0.92 THEN 'strong' ELSE 'ok' END status FROM ty LEFT JOIN w USING (type)")
def _(spark, sf):
    t = B.table(spark, sf, "embeddings").select(F.concat(F.lit("type-"), F.when(F.col("vec_id") % 50 == 0, "none").otherwise(F.col("label").cast("string"))).alias("type")).distinct()
    return A.type_status(t, coverage(spark, sf)).select("type", r6("worst"), "status")


@query("probe_deltas", f"WITH {PROBE} SELECT a.dataset, round(a.acc-b.acc,6) delta FROM cv a JOIN cv b ON a.dataset=b.dataset AND a.mode='deploy' AND b.mode='robust'")
def _(spark, sf):
    c = coverage(spark, sf)
    old = c.filter("mode = 'robust'").select("dataset", F.col("acc").alias("before"))
    return c.filter("mode = 'deploy'").join(old, "dataset").select("dataset", r6(F.col("acc") - F.col("before"), "delta"))


# ---- statistics of arrays -----------------------------------------------------------------------

ARR = """x AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) a FROM embeddings),
 st AS (SELECT vec_id, label, list_avg(a) mean, list_stddev_pop(a) std, list_min(a) low, list_max(a) high, list_avg(list_transform(range(2,65), lambda i: abs(a[i]-a[i-1]))) edge FROM x)"""


@query("array_stats", f"WITH {ARR} SELECT vec_id, round(mean,6) mean, round(std,6) std, round(low,6) low, round(high,6) high, round(edge,6) edge FROM st")
def _(spark, sf):
    s = A.array_stats(B.table(spark, sf, "embeddings"), "vec_id", "embedding")
    return s.select("vec_id", *[r6(c) for c in ("mean", "std", "low", "high", "edge")])


_SA = " UNION ALL ".join(f"SELECT '{c}' stat, round({c},9) sv, CASE WHEN label>=5 THEN 1 ELSE 0 END y FROM st" for c in ("mean", "std", "low", "high", "edge"))


@query("stat_aucs", f"WITH {ARR}, sa AS ({_SA}) SELECT stat, n, round(greatest(auc,1-auc),6) auc FROM " + auc_sql("sa", ["stat"], "sv", "y"))
def _(spark, sf):
    e = B.table(spark, sf, "embeddings")
    names = ["mean", "std", "low", "high", "edge"]
    s = A.array_stats(e, "vec_id", "embedding").select("vec_id", *[F.round(c, 9).alias(c) for c in names])
    lab = e.select("vec_id", F.when(F.col("label") >= 5, 1).otherwise(0).alias("label"))
    return A.stat_aucs(s, lab, "vec_id", names).select("stat", "n", r6("auc"))


def _power(u, v):
    return "+".join(f"pow(list_sum(list_transform(range(64), lambda i: a[i+1]*{f}(2*pi()*((({u})*(i//8)+({v})*(i%8))%8)/8))),2)" for f in ("cos", "sin"))


def _mean(pairs):
    return f"list_avg([{','.join(f'abs(a[{x + 1}]-a[{y + 1}])' for x, y in pairs)}])"


_WAVES = A.frequencies(8)
_BANDS = [[i for i, w in enumerate(_WAVES) if lo <= w[2] < hi] for lo, hi in zip(A.BAND_ENDS, A.BAND_ENDS[1:], strict=False)]
_SUM = lambda ids: "(" + ("+".join(f"w[{i + 1}]" for i in ids) or "0.0::DOUBLE") + ")"
_ACROSS = {x: [(8 * y + x + 1, 8 * y + x) for y in range(8)] for x in range(7)}
_DOWN = {y: [(8 * y + 8 + x, 8 * y + x) for x in range(8)] for y in range(7)}
_ON = lambda steps, on: _mean([p for k, v in steps.items() if on is None or ((k + 1) % 4 == 0) == on for p in v])
GRID_SQL = f"""x AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) a FROM embeddings),
 p AS (SELECT *, [{','.join(_power(u, v) for u, v, _ in _WAVES)}] w, list_min(a) lo, greatest(list_max(a)-list_min(a),CAST(1e-12 AS DOUBLE)) wd FROM x),
 g AS (SELECT vec_id, label, {','.join(f"ln(1+{_SUM(b)}/{max(len(b), 1)}) band_{k}" for k, b in enumerate(_BANDS))},
  ln(1+{_SUM([i for i, w in enumerate(_WAVES) if w[2] > A.HIGH_FROM])}/greatest({_SUM([i for i, w in enumerate(_WAVES) if 0 < w[2] <= A.LOW_TO])},CAST(1e-9 AS DOUBLE))) hf_lf,
  ({'+'.join(f"{_ON(s, True)}/greatest({_ON(s, False)},CAST(1e-9 AS DOUBLE))" for s in (_ACROSS, _DOWN))})/2 blockiness,
  ({'+'.join(_ON(s, None) for s in (_ACROSS, _DOWN))})/2 edge_density,
  (SELECT -sum(c/CAST(64 AS DOUBLE)*log2(c/CAST(64 AS DOUBLE))) FROM (SELECT count(*) c FROM (SELECT unnest(a) e) GROUP BY least(floor((e-lo)/wd*16),15))) entropy FROM p)"""


@query("grid_stats", f"WITH {GRID_SQL} SELECT vec_id, {', '.join(f'round({c},6) {c}' for c in A.GRID_STATS)} FROM g")
def _(spark, sf):
    s = A.grid_stats(B.table(spark, sf, "embeddings"), "vec_id", "embedding")
    return s.select("vec_id", *[r6(c) for c in A.GRID_STATS])


_GA = " UNION ALL ".join(f"SELECT '{c}' stat, round({c},6) sv, CASE WHEN label>=5 THEN 1 ELSE 0 END y FROM g" for c in A.GRID_STATS)


@query("grid_stat_aucs", f"WITH {GRID_SQL}, sa AS ({_GA}) SELECT stat, n, round(greatest(auc,1-auc),6) auc FROM " + auc_sql("sa", ["stat"], "sv", "y"))
def _(spark, sf):
    e = B.table(spark, sf, "embeddings")
    lab = e.select("vec_id", F.when(F.col("label") >= 5, 1).otherwise(0).alias("label"))
    s = A.grid_stats(e, "vec_id", "embedding").select("vec_id", *[r6(c) for c in A.GRID_STATS])
    return A.stat_aucs(s, lab, "vec_id", A.GRID_STATS).select("stat", "n", r6("auc"))


# Three channels from every vector: its numbers scaled to 0..255, from another place on for each channel, on sides of 8 and of 16.
_SHADE = "CAST(least(greatest(floor(128+60*CAST(embedding[({p}*{m}+{s})%64+1] AS DOUBLE)),0),255) AS DOUBLE)"
_PX = lambda side, m: (f"SELECT vec_id, {side} side, p//{side} y, p%{side} x, {_SHADE.format(p='p', m=m, s=0)} r, {_SHADE.format(p='p', m=m, s=21)} g, {_SHADE.format(p='p', m=m, s=42)} b"  # noqa: E731
                       f" FROM embeddings, unnest(range({side * side})) t(p)")
_WAVE = lambda side: ",".join(f"({side},{u},{v},CAST({float(r)!r} AS DOUBLE))" for (u, v), r in P.np.ndenumerate(P.frequencies(side)))
PIXELS = f"""px AS ({_PX(8, 1)} UNION ALL {_PX(16, 5)}), l AS (SELECT *, 0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b sc, (greatest(r,g,b)-least(r,g,b))/255 sat FROM px),
 wv(side,u,v,f) AS (VALUES {_WAVE(8)},{_WAVE(16)}),
 pw AS (SELECT l.vec_id, l.side, f, pow(sum(sc/255*cos(2*pi()*((u*y+v*x)%l.side)/l.side)),2)+pow(sum(sc/255*sin(2*pi()*((u*y+v*x)%l.side)/l.side)),2) p FROM l JOIN wv USING (side) GROUP BY l.vec_id, l.side, u, v, f),
 fb AS (SELECT vec_id, side, {', '.join(f"ln(1+coalesce(avg(p) FILTER (WHERE f>={lo!r}::DOUBLE AND f<{hi!r}::DOUBLE),0)) fft_band_{k}" for k, (lo, hi) in enumerate(zip(P.BAND_ENDS, P.BAND_ENDS[1:], strict=False)))},
  ln(1+coalesce(sum(p) FILTER (WHERE f>{P.HIGH_FROM}),0)/greatest(coalesce(sum(p) FILTER (WHERE f>0 AND f<={P.LOW_TO}),0),1e-9)) hf_lf_ratio FROM pw GROUP BY 1,2),
 sp AS (SELECT a.vec_id, a.side, 'h' k, (b.x%8=0) e, abs(b.sc-a.sc)/255 d FROM l a JOIN l b ON a.vec_id=b.vec_id AND a.side=b.side AND a.y=b.y AND b.x=a.x+1
  UNION ALL SELECT a.vec_id, a.side, 'v', (b.y%8=0), abs(b.sc-a.sc)/255 FROM l a JOIN l b ON a.vec_id=b.vec_id AND a.side=b.side AND a.x=b.x AND b.y=a.y+1),
 sk AS (SELECT vec_id, side, k, avg(d) FILTER (WHERE e)/greatest(avg(d) FILTER (WHERE NOT e),1e-9) bl, avg(d) m FROM sp GROUP BY ALL), sd AS (SELECT vec_id, side, avg(bl) blockiness, avg(m) edge_density FROM sk GROUP BY ALL),
 hs AS (SELECT vec_id, side, least(floor(sc*32/255),31) lv, count(*)/CAST(max(side)*max(side) AS DOUBLE) q FROM l GROUP BY ALL), en AS (SELECT vec_id, side, -sum(q*log2(q)) hist_entropy FROM hs GROUP BY ALL),
 ch AS (SELECT vec_id, side, {', '.join(f"avg({c}/255) mean_{c}, stddev_samp({c}/255) std_{c}" for c in 'rgb')}, avg(sat) sat_mean, stddev_samp(sat) sat_std FROM l GROUP BY ALL)"""


@query("pixel_stats", f"WITH {PIXELS} SELECT vec_id, side, {', '.join(f'round({c},6) {c}' for c in P.PIXEL_STATS)} FROM ch JOIN fb USING (vec_id, side) JOIN sd USING (vec_id, side) JOIN en USING (vec_id, side)")
def _(spark, sf):
    e = B.table(spark, sf, "embeddings")

    def shades(side, m, shift):
        at = lambda i: F.get("embedding", ((i * m + shift) % 64).cast("int")).cast("double")
        return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.least(F.greatest(F.floor(at(i) * 60 + 128), F.lit(0)), F.lit(255)))
    made = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), *[shades(s, m, k).alias(c) for c, k in zip("rgb", (0, 21, 42), strict=True)]) for s, m in ((8, 1), (16, 5))])).alias("s")
    grids = e.select("vec_id", made).select(F.struct("vec_id", "s.side").alias("k"), "s.r", "s.g", "s.b")
    return P.pixel_stats(grids, "k", "r", "g", "b").select("k.*", *[r6(c) for c in P.PIXEL_STATS])


VARIANTS = """x AS (SELECT vec_id, label, 'plain' variant, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) a FROM embeddings),
 y AS (SELECT * FROM x UNION ALL SELECT vec_id, label, 'smooth', list_transform(range(1,64), lambda i: (a[i]+a[i+1])/2) FROM x),
 st AS (SELECT vec_id, label, variant, list_stddev_pop(a) std, list_max(a) high FROM y),
 sa AS (SELECT variant, 'std' stat, round(std,9) sv, CASE WHEN label>=5 THEN 1 ELSE 0 END lb FROM st UNION ALL SELECT variant, 'high', round(high,9), CASE WHEN label>=5 THEN 1 ELSE 0 END FROM st)"""


@query("variant_deltas", f"WITH {VARIANTS}, au AS (SELECT variant, stat, greatest(auc,1-auc) auc FROM " + auc_sql("sa", ["variant", "stat"], "sv", "lb")
       + ") SELECT v.variant, v.stat, round(v.auc,6) auc, round(b.auc,6) auc_base, round(v.auc-b.auc,6) delta FROM au v JOIN au b ON v.stat=b.stat AND b.variant='plain' WHERE v.variant<>'plain'")
def _(spark, sf):
    e = B.table(spark, sf, "embeddings")
    a = F.transform("embedding", lambda x: x.cast("double"))
    smooth = F.zip_with(F.slice(a, 1, 63), F.slice(a, 2, 63), lambda x, y: (x + y) / 2)
    made = F.explode(F.array(F.struct(F.lit("plain").alias("variant"), a.alias("a")), F.struct(F.lit("smooth").alias("variant"), smooth.alias("a"))))
    v = e.select("vec_id", "label", made.alias("s")).select(F.concat_ws("|", "vec_id", "s.variant").alias("k"), "label", "s.variant", "s.a")
    st = A.array_stats(v, "k", "a").select("k", F.round("std", 9).alias("std"), F.round("high", 9).alias("high"))
    lab = v.select("k", "variant", F.when(F.col("label") >= 5, 1).otherwise(0).alias("label"))
    d = A.variant_deltas(A.stat_aucs(st, lab, "k", ["std", "high"], ["variant"]), "plain")
    return d.select("variant", "stat", r6("auc"), r6("auc_base"), r6("delta"))


def _tensors(spark, sf):
    """Statistics of every document's word lengths as they are and under three variants of the text, its rows on folds that keep
    datasets whole, and three format flags."""
    m = B.split_manifest(spark, sf, folded=False)
    text = F.coalesce("text", F.lit(""))
    plain = lambda t: F.regexp_replace(t, "[0-9]", "")
    joined = lambda t: F.regexp_replace(t, r"(\w)-(\w)", "$1$2")
    made = {"deploy": F.col("text"), "no_digits": F.col("plain"), "joined": joined(F.col("text")), "both": joined(F.col("plain"))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), t.alias("text")) for k, t in made.items()])).alias("s")
    d = B.table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("image_id"), text.alias("text"))
    d = d.withColumn("plain", plain(F.col("text"))).select("image_id", each)
    stats = A.word_stats(d.select(F.struct("image_id", "s.variant").alias("k"), "s.text"), "k", "text").select("k.*", *STATS)
    rows = m.join(W.blocked_folds(m, 3, "dataset").select(F.col("block").alias("dataset"), "fold"), "dataset")
    flags = {"is_png": F.col("file_format") == "PNG", "non_rgb": F.col("pil_mode") != "RGB", "upsampled": F.col("m_eval") > 1}
    return stats, rows, flags


STATS = ["mean", "std", "low", "high", "edge"]


@query("nuisance_survival")
def _(spark, sf):
    stats, rows, flags = _tensors(spark, sf)
    results, _ = A.tensor_probes(stats, rows, flags, STATS, "deploy", shape=TREES)
    return A.survival(results, list(flags)).select("nuisance", r6("survival_auc"), r6("label_auc"), "unmeasurable", "live", "verdict")


@query("audit_tensor_rows")
def _(spark, sf):
    return mode_rows(MO.tensor_rows(*_tensors(spark, sf), STATS, "deploy", shape=TREES))


# ---- modes: ledger rows -------------------------------------------------------------------------

MODE = ("key_str", "n", "headline", "value", "verdict")


def mode_rows(r):
    return r.select("key_str", "n", "headline", r6("value"), "verdict")


_S = {**SQL, **EV.SQL}
_row = lambda mode, test, split, key, headline, value, verdict, src, n="n": (
    f"SELECT concat('{mode}|{test}|',{split},'|',{key}) key_str, CAST({n} AS BIGINT) n, '{headline}' headline, CAST({value} AS DOUBLE) AS value, {verdict} verdict FROM ({src})")
_over = lambda v, name: X_VERDICT.format(v=v, w=L.limits(name)[0], h="NULL" if L.limits(name)[1] is None else L.limits(name)[1])
X_VERDICT = "CASE WHEN {v}>CAST({h} AS DOUBLE) THEN 'hard' WHEN {v}>{w} THEN 'warn' ELSE 'ok' END"


@query("audit_metadata_rows", " UNION ALL ".join([
    _row("metadata", "M2_feature_auc", "'all'", "concat('feature=',feature)", "auc", "auc", "verdict", _S["feature_aucs"]),
    _row("metadata", "M5_category_prior", "split", "''", "worst_prior", "worst_prior", _over("worst_prior", "category_prior"), _S["mutual_information"])]))
def _(spark, sf):
    return mode_rows(MO.metadata_rows(B.split_manifest(spark, sf), NUM, ("ext", "file_format", "pil_mode")))


_GAP = "WITH " + SCORED_MANIFEST + """, c AS (SELECT split, category, count(*) n, avg(((d>0)=(label=1))::INT) FILTER (WHERE label=0) r, avg(((d>0)=(label=1))::INT) FILTER (WHERE label=1) f FROM sf GROUP BY ALL)
 SELECT split, sum(n) n, round(coalesce(max(abs(r-f)),0),6) gap FROM c GROUP BY 1"""
_DS = "WITH " + SCORED_MANIFEST + " SELECT split, dataset, count(*) n, round(avg(((d>0)=(label=1))::INT),6) acc FROM sf GROUP BY ALL"
_KN = "WITH " + SPLIT + " SELECT split, count(*) n FROM s GROUP BY 1"


@query("audit_slice_rows", " UNION ALL ".join([
    _row("slices", "', CASE flag WHEN 'is_png' THEN 'S1_codec_nuisance' ELSE 'S6_pilmode_nuisance' END, '", "split", "''", "auc", "auc", "verdict",
         f"SELECT * FROM ({_S['nuisance_aucs']}) WHERE branch='fused' AND flag<>'upsampled'"),
    _row("slices", "S2_resolution_rho", "split", "CASE label WHEN 0 THEN 'class=real' ELSE 'class=fake' END", "abs_rho", "abs(rho)",
         f"CASE WHEN label=0 THEN {_over('abs(rho)', 'margin_rho')} ELSE 'ok' END", f"SELECT * FROM ({_S['margin_resolution_rho']}) WHERE n>=30"),
    _row("slices", "S3_category_gap", "split", "''", "worst_gap", "gap", _over("gap", "slice_gap"), _GAP),
    _row("slices", "S4_dataset_acc", "split", "concat('dataset=',dataset)", "acc", "acc", "'ok'", _DS),
    _row("slices", "S5_kind", "split", "''", "deficit", "deficit", "verdict", f"SELECT * FROM ({_S['kind_deficit']}) JOIN ({_KN}) USING (split)")]))
def _(spark, sf):
    return mode_rows(MO.slice_rows(fused_manifest(spark, sf), floor=30))


@query("audit_pair_rows", " UNION ALL ".join([
    _row("pairs", "P1_fake_drop", "'all'", "''", "drop", '"drop"', "verdict", f"SELECT * FROM ({_S['pair_drop']}), ({PAIRS} SELECT count(*) n FROM pr WHERE in_pair)"),
    _row("pairs", "P2_confound", "'all'", "concat('against=',against)", "rho", "rho", "verdict", f"SELECT * FROM ({_S['pair_confounds']}) WHERE n>=4"),
    _row("pairs", "P_unit", "'all'", "concat('unit=',split_unit)", "acc_fake", "acc_fake", "verdict",
         f"SELECT u.*, CASE WHEN f.split_unit IS NULL THEN 'ok' ELSE 'warn' END verdict FROM ({_S['pair_units']}) u LEFT JOIN ({_S['pair_fpr_flags']}) f USING (split_unit)"),
    _row("pairs", "P3_unit_fpr", "'all'", "concat('unit=',split_unit)", "real_fpr", "real_fpr", "'warn'", _S["pair_fpr_flags"], "n_real"),
    _row("pairs", "P3_real_fpr", "'all'", "''", "flagged_units", "k", "CASE WHEN k>0 THEN 'warn' ELSE 'ok' END",
         f"SELECT (SELECT count(*) FROM ({_S['pair_fpr_flags']})) k, ({PAIRS} SELECT count(*) n FROM pr WHERE in_pair) n")]))
def _(spark, sf):
    return mode_rows(MO.pair_rows(paired(spark, sf)))


@query("audit_intervention_rows", _row("interventions", "I1_flips", "'all'", "concat('intervention=',intervention,',setting=',setting)", "flip_real", "flip_real", "verdict", _S["flip_report"]))
def _(spark, sf):
    b, a = interventions(spark, sf)
    return mode_rows(MO.intervention_rows(b, a, "vec_id", ["shift"]))


@query("probe_rows", _row("probes", "B1_probe_acc", "mode", "concat('dataset=',dataset,',type=',type)", "acc", "acc", "'ok'", _S["probe_coverage"]))
def _(spark, sf):
    return mode_rows(MO.probe_rows(coverage(spark, sf)))
