"""Queries over weights, scores, margins and probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.functions import ranking as R
from plumbline.functions import scalar as S
from plumbline.operators import evaluation as E
from plumbline.operators import ingest as I
from plumbline.catalog.base import r6, registrar, rows
from plumbline.catalog.sqltext import FUSION, MANIFEST, SCORED_MANIFEST, SPLIT, fused, quantile, scored, sigmoid

Q, SQL, query = registrar()


def fused_scored(spark, sf, view="deploy"):
    s = E.with_fusion(B.scored(spark, sf, view), FUSION)
    return s.withColumn("p", S.sigmoid(F.col("margin"))).withColumn("view", F.lit(view))


def fused_manifest(spark, sf):
    s = E.with_fusion(B.scored_manifest(spark, sf), FUSION)
    return s.withColumn("p", S.sigmoid(F.col("margin")))


MCC = "CASE WHEN sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn))>0 THEN (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END"


def quality(mcc, brier, base="CAST(0.25 AS DOUBLE)"):
    return f"sqrt(pow(greatest(({mcc}+1)/2.0,0),1.2)*pow(greatest(({base}-{brier})/{base},0),1.8))"


def conf(w="1.0", y="y", p="p"):
    return (f"coalesce(sum({w}) FILTER (WHERE {y}=1 AND {p}>0.5),0) tp, coalesce(sum({w}) FILTER (WHERE {y}=0 AND {p}<=0.5),0) tn, "
            f"coalesce(sum({w}) FILTER (WHERE {y}=0 AND {p}>0.5),0) fp, coalesce(sum({w}) FILTER (WHERE {y}=1 AND {p}<=0.5),0) fn, "
            f"sum({w}*pow(least(greatest({p},1e-7),1-1e-7)-{y},2))/sum({w}) br, sum({w}) sw, count(*) n")


P = f"pr AS (SELECT *, {sigmoid('d')} p FROM sc)"
WEIGHTED = f"WITH {fused()}, {P}" + """, pc AS (SELECT *, CASE WHEN dataset LIKE '%-0' THEN 'holdout' WHEN dataset LIKE '%-1' THEN 'stream' ELSE 'public' END cls FROM pr),
 cn AS (SELECT cls, count(*) n, CASE cls WHEN 'public' THEN 0.5 WHEN 'holdout' THEN 0.35 ELSE 0.15 END t FROM pc GROUP BY 1),
 cw AS (SELECT cls, CAST(t AS DOUBLE)/sum(t) OVER ()*sum(n) OVER ()/n w FROM cn), wt AS (SELECT pc.*, w FROM pc JOIN cw USING (cls))"""
SHARES = {"public": 0.50, "holdout": 0.35, "stream": 0.15}


def provenance_rows(spark, sf, view="deploy"):
    s = fused_scored(spark, sf, view)
    cls = F.when(F.col("dataset").endswith("-0"), "x-holdout-").when(F.col("dataset").endswith("-1"), B.STREAM_MARKER).otherwise("")
    return s.withColumn("cls", S.provenance(cls, B.STREAM_MARKER))


@query("provenance_weights", WEIGHTED + " SELECT vec_id, cls, round(w,9) weight FROM wt")
def _(spark, sf):
    return E.share_weights(provenance_rows(spark, sf), "cls", SHARES).select("vec_id", "cls", F.round("weight", 9).alias("weight"))


@query("weighted_scores", WEIGHTED + f", a AS (SELECT {conf('w')} FROM wt) SELECT n, round((tp+tn)/sw,6) accuracy, round({MCC},6) mcc, round(br,6) brier, round({quality(MCC, 'br')},6) score FROM a")
def _(spark, sf):
    w = E.share_weights(provenance_rows(spark, sf), "cls", SHARES)
    return E.binary_scores(w, [], "y", "p", "weight").select("n", r6("accuracy"), r6("mcc"), r6("brier"), r6("score"))


@query("dataset_scores", f"WITH {fused()}, {P}, a AS (SELECT dataset, {conf()} FROM pr GROUP BY 1) SELECT dataset, n, round((tp+tn)/sw,6) accuracy, round({MCC},6) mcc, round(br,6) brier, round({quality(MCC, 'br')},6) score FROM a")
def _(spark, sf):
    s = E.binary_scores(fused_scored(spark, sf), ["dataset"], "y", "p")
    return s.select("dataset", "n", r6("accuracy"), r6("mcc"), r6("brier"), r6("score"))


@query("class_balance_weights", "WITH " + scored() + """, c AS (SELECT y, count(*) n FROM sc GROUP BY 1)
 SELECT vec_id, round(CASE y WHEN 1 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END*(SELECT sum(n) FROM c)/n,9) weight FROM sc JOIN c USING (y)""")
def _(spark, sf):
    return E.share_weights(B.scored(spark, sf), "y", E.class_targets(0.6)).select("vec_id", F.round("weight", 9).alias("weight"))


@query("three_class_weights", "WITH " + scored() + """, c AS (SELECT y3, count(*) n FROM sc GROUP BY 1)
 SELECT vec_id, round(CASE y3 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END*(SELECT sum(n) FROM c)/n,9) weight FROM sc JOIN c USING (y3)""")
def _(spark, sf):
    return E.share_weights(B.scored(spark, sf), "y3", E.three_class_targets(0.1)).select("vec_id", F.round("weight", 9).alias("weight"))


@query("carried_weights", WEIGHTED + ", b AS (SELECT dataset, max(w) w FROM wt WHERE dataset<>'emb-1-1' GROUP BY 1) SELECT vec_id, round(coalesce(b.w,1),9) weight FROM pr LEFT JOIN b USING (dataset)")
def _(spark, sf):
    base = E.share_weights(provenance_rows(spark, sf), "cls", SHARES).filter("dataset <> 'emb-1-1'")
    return E.carry_weights(fused_scored(spark, sf, "robust"), base, "dataset").select("vec_id", F.round("weight", 9).alias("weight"))


BAL = """a AS (SELECT view, count(*) n, avg(CASE WHEN p>0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE y=1) r1, avg(CASE WHEN p>0.5 THEN 0.0 ELSE 1.0 END) FILTER (WHERE y=0) r0,
 avg(pow(p-y,2)) FILTER (WHERE y=1) b1, avg(pow(p-y,2)) FILTER (WHERE y=0) b0 FROM v GROUP BY 1),
 b AS (SELECT view, n, 0.5*r1 tp, 0.5*r0 tn, 0.5*(1-r0) fp, 0.5*(1-r1) fn, 0.5*b0+0.5*b1 br FROM a)"""
VIEWS = f"{fused()}, {fused('robust', 'rb')}, v AS (SELECT 'base' view, y, {sigmoid('d')} p FROM sc UNION ALL SELECT 'aug', y, {sigmoid('d')} FROM rb)"


def both_views(spark, sf):
    return fused_scored(spark, sf).withColumn("view", F.lit("base")).unionByName(
        fused_scored(spark, sf, "robust").withColumn("view", F.lit("aug")))


@query("balanced_scores", f"WITH {VIEWS}, {BAL} SELECT view, n, round(tp+tn,6) accuracy, round({MCC},6) mcc, round(br,6) brier, round({quality(MCC, 'br')},6) score FROM b")
def _(spark, sf):
    s = E.balanced_scores(both_views(spark, sf), ["view"], "y", "p")
    return s.select("view", "n", r6("accuracy"), r6("mcc"), r6("brier"), r6("score"))


@query("blended_score", f"WITH {VIEWS}, {BAL}, q AS (SELECT view, {quality(MCC, 'br')} s FROM b), r AS (SELECT max(s) FILTER (WHERE view='base') base, max(s) FILTER (WHERE view='aug') aug FROM q) SELECT round(base,6) base, round(aug,6) aug, round(0.8*base+0.2*aug,6) blended FROM r")
def _(spark, sf):
    s = E.blended(E.balanced_scores(both_views(spark, sf), ["view"], "y", "p"), [], "view")
    return s.select(r6("base"), r6("aug"), r6("blended"))


COMP = f"""{fused()}, th AS (SELECT vec_id, y3, t, least(greatest({sigmoid('d/(CAST(0.8 AS DOUBLE)*(1+CAST(0.5 AS DOUBLE)*greatest(spread-0.3,0)))')},CAST(0.02 AS DOUBLE)),CAST(0.97 AS DOUBLE)) pf,
 least(greatest({sigmoid('t/CAST(1.5 AS DOUBLE)-0.4')},CAST(0.001 AS DOUBLE)),CAST(0.9 AS DOUBLE)) qq FROM sc), c3 AS (SELECT vec_id, y3, 1-pf p0, pf*(1-qq) p1, pf*qq p2 FROM th)"""


def composed(spark, sf):
    s = fused_scored(spark, sf)
    p = S.hinge_probability(F.col("margin"), F.col("spread"), 0.8, 0.5, 0.3, 0.02, 0.97)
    q = S.type_posterior(F.col("d2"), 1.5, -0.4, 0.001, 0.9)
    return s.withColumn("probs", S.compose_three(p, q))


@query("composed_probabilities", f"WITH {COMP} SELECT vec_id, round(p0,6) p_real, round(p1,6) p_synthetic, round(p2,6) p_semi FROM c3")
def _(spark, sf):
    e = [F.element_at("probs", i) for i in (1, 2, 3)]
    return composed(spark, sf).select("vec_id", r6(e[0], "p_real"), r6(e[1], "p_synthetic"), r6(e[2], "p_semi"))


CONF3 = ", ".join(f"sum(w) FILTER (WHERE y3={i} AND pd={j}) c{i}{j}" for i in range(3) for j in range(3))
C0 = {f"{i}{j}": f"coalesce(c{i}{j},0)" for i in range(3) for j in range(3)}
T3 = [" + ".join(C0[f"{i}{j}"] for j in range(3)) for i in range(3)]
P3 = [" + ".join(C0[f"{i}{j}"] for i in range(3)) for j in range(3)]
THREE = f"""k AS (SELECT y3, count(*) n FROM c3 GROUP BY 1), w3 AS (SELECT c3.*, CASE WHEN p0>=p1 AND p0>=p2 THEN 0 WHEN p1>=p2 THEN 1 ELSE 2 END pd,
  CASE y3 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END*(SELECT count(*) FROM c3)/k.n w FROM c3 JOIN k USING (y3)),
 g AS (SELECT count(*) n, sum(w) s, sum(w*(pow(p0-(y3=0)::INT,2)+pow(p1-(y3=1)::INT,2)+pow(p2-(y3=2)::INT,2)))/sum(w) br, {CONF3} FROM w3),
 h AS (SELECT n, br, s, {C0['00']}+{C0['11']}+{C0['22']} hit, {T3[0]} t0, {T3[1]} t1, {T3[2]} t2, {P3[0]} q0, {P3[1]} q1, {P3[2]} q2, {C0['00']} h0, {C0['11']} h1, {C0['22']} h2 FROM g),
 rk AS (SELECT *, (hit*s-(t0*q0+t1*q1+t2*q2))/sqrt((s*s-(q0*q0+q1*q1+q2*q2))*(s*s-(t0*t0+t1*t1+t2*t2))) rk FROM h)"""


@query("multiclass_scores", f"WITH {COMP}, {THREE} SELECT n, round(rk,6) gorodkin, round(br,6) brier, round({quality('rk', 'br', '(CAST(2 AS DOUBLE)/3)')},6) score, round(h0/t0,6) recall_real, round(h1/t1,6) recall_synthetic, round(h2/t2,6) recall_semisynthetic FROM rk")
def _(spark, sf):
    w = E.share_weights(composed(spark, sf), "y3", E.three_class_targets(0.3))
    s = E.three_class_scores(w, [], "y3", "probs", "weight")
    return s.select("n", *[r6(c) for c in s.columns if c != "n"])


HIT = "CASE WHEN (d>0)=(label=1) THEN CAST(1 AS DOUBLE) ELSE 0 END"
SLICES = "WITH " + SCORED_MANIFEST + "".join(
    f"{', sl AS (' if i == 0 else ' UNION ALL '}SELECT '{s}' slice, {s} AS value, count(*) n, avg({HIT}) acc, avg({HIT}) FILTER (WHERE label=0) acc_real, avg({HIT}) FILTER (WHERE label=1) acc_fake FROM sf GROUP BY {s}"
    for i, s in enumerate(("category", "dataset", "kind"))) + ")"


@query("slice_accuracy", SLICES + " SELECT slice, value, n, round(acc,6) acc, round(acc_real,6) acc_real, round(acc_fake,6) acc_fake FROM sl")
def _(spark, sf):
    s = E.slice_accuracy(fused_manifest(spark, sf), ["category", "dataset", "kind"], "label", "margin")
    return s.select("slice", "value", "n", r6("acc"), r6("acc_real"), r6("acc_fake"))


@query("worst_gap", SLICES + " SELECT slice, value, round(abs(acc_real-acc_fake),6) gap FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY round(abs(acc_real-acc_fake),9) DESC, value) r FROM sl WHERE acc_real IS NOT NULL AND acc_fake IS NOT NULL) WHERE r=1")
def _(spark, sf):
    s = E.slice_accuracy(fused_manifest(spark, sf), ["category", "dataset", "kind"], "label", "margin")
    return E.worst_gap(s).withColumn("gap", F.round("gap", 6))


@query("worst_datasets", SLICES + " SELECT value dataset, n, round(acc,6) acc FROM sl WHERE slice='dataset' ORDER BY round(acc,9), value LIMIT 15")
def _(spark, sf):
    s = E.slice_accuracy(fused_manifest(spark, sf), ["dataset"], "label", "margin")
    return s.orderBy(F.round("acc", 9), "value").limit(15).select(F.col("value").alias("dataset"), "n", r6("acc"))


@query("mutual_information", "WITH " + SPLIT + """, c AS (SELECT split, category, label, count(*) n FROM s GROUP BY ALL),
 e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY split) AS DOUBLE) t, sum(n) OVER (PARTITION BY split, category) nc, sum(n) OVER (PARTITION BY split, label) nl FROM c),
 p AS (SELECT split, category, sum(n/t*log2(n*t/(nc*nl))) mi, max(t) t, max(nc) nc, coalesce(sum(n) FILTER (WHERE label=1),0) f FROM e GROUP BY 1,2),
 o AS (SELECT *, CASE WHEN nc/t>=0.05 THEN abs(CAST(f AS DOUBLE)/nc-0.5) ELSE 0 END off FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round(off,9) DESC, category) rn FROM o)
 SELECT split, CAST(max(t) AS BIGINT) n, round(sum(mi),6) mi_bits, round(max(off),6) worst_prior, CASE WHEN max(off)>0 THEN max(category) FILTER (WHERE rn=1) ELSE '' END worst_category
 FROM r GROUP BY 1 HAVING max(t)>=100 AND sum(f)>0 AND sum(f)<max(t)""")
def _(spark, sf):
    m = E.mutual_information(B.split_manifest(spark, sf), "split", "category", "label")
    return m.select("split", "n", r6("mi_bits"), r6("worst_prior"), "worst_category")


def auc_sql(src, groups, score, flag):
    """AUC by average ranks."""
    g = ", ".join(groups)
    part = f"PARTITION BY {g} " if g else ""
    return f"""(SELECT {g + ',' if g else ''} count(*) n, CASE WHEN sum(f)>0 AND sum(f)<count(*) THEN (sum(f*rk)-sum(f)*(sum(f)+1)/2.0)/(CAST(sum(f) AS DOUBLE)*(count(*)-sum(f))) END auc
 FROM (SELECT {g + ',' if g else ''} {flag} f, rank() OVER ({part}ORDER BY {score})+(count(*) OVER ({part.rstrip() + ', ' if g else 'PARTITION BY '}{score})-1)/2.0 rk FROM {src} WHERE {score} IS NOT NULL) {'GROUP BY ' + g if g else ''})"""


@query("label_auc", f"WITH {SCORED_MANIFEST}" + " SELECT split, n, round(auc,6) auc, round(greatest(auc,1-auc),6) folded FROM " + auc_sql("sf", ["split"], "round(d,2)", "label"))
def _(spark, sf):
    m = fused_manifest(spark, sf).withColumn("score", F.round("margin", 2))
    a = R.rank_auc(m, ["split"], "score", "label")
    return a.select("split", "n", r6("auc"), r6(R.folded(F.col("auc")), "folded"))


@query("overall_auc", f"WITH {fused()} SELECT n, round(auc,6) auc FROM " + auc_sql("sc", [], "d", "y"))
def _(spark, sf):
    return R.rank_auc(fused_scored(spark, sf), [], "margin", "y").select("n", r6("auc"))


def rho_sql(src, groups, a, b):
    g = ", ".join(groups)
    rk = lambda c: f"rank() OVER (PARTITION BY {g} ORDER BY {c})+(count(*) OVER (PARTITION BY {g}, {c})-1)/2.0"
    return f"""(SELECT {g}, count(*) n, CASE WHEN count(*)>=3 AND stddev_pop(ra)>0 AND stddev_pop(rb)>0 THEN corr(ra,rb) END rho FROM (SELECT {g}, {rk(a)} ra, {rk(b)} rb FROM {src}) GROUP BY {g})"""


@query("margin_resolution_rho", "WITH " + SCORED_MANIFEST + ", lm AS (SELECT *, ln(m_eval) lg FROM sf) SELECT split, label, n, round(rho,6) rho FROM " + rho_sql("lm", ["split", "label"], "d", "lg"))
def _(spark, sf):
    m = fused_manifest(spark, sf).withColumn("log_m", F.log("m_eval"))
    return R.spearman(m, ["split", "label"], "margin", "log_m").withColumn("rho", F.round("rho", 6))


def cdf_sql(x):
    """functions.scalar.normal_cdf in SQL."""
    t = f"(1/(1+0.3275911*abs({x})/sqrt(CAST(2 AS DOUBLE))))"
    poly = "0"
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = f"(({poly}+({c}))*{t})"
    return f"(0.5+CASE WHEN {x}>=0 THEN 0.5 ELSE -0.5 END*(1-{poly}*exp(-({x})*({x})/2)))"


def probit_sql(p):
    """functions.scalar.probit in SQL, for 0.02425 <= p <= 0.97575."""
    def poly(coef, x):
        out = f"CAST({coef[0]} AS DOUBLE)"
        for c in coef[1:]:
            out = f"({out}*{x}+({c}))"
        return out
    a = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
    b = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0)
    r = f"(({p}-0.5)*({p}-0.5))"
    return f"({poly(a, r)}*({p}-0.5)/{poly(b, r)})"


@query("auc_ceilings", f"WITH {SCORED_MANIFEST}, a AS (SELECT * FROM " + auc_sql("sf", ["split"], "round(d,1)", "CASE WHEN file_format='PNG' THEN 1 ELSE 0 END")
       + f"), z AS (SELECT split, auc, {probit_sql('auc')}/sqrt(CAST(2 AS DOUBLE)) x FROM a) SELECT split, round(auc,6) auc, round({cdf_sql('x')},5) ceiling FROM z")
def _(spark, sf):
    m = fused_manifest(spark, sf)
    m = m.withColumn("score", F.round("margin", 1)).withColumn("png", (F.col("file_format") == "PNG").cast("int"))
    a = R.rank_auc(m, ["split"], "score", "png")
    return a.select("split", r6("auc"), F.round(S.auc_ceiling(F.col("auc")), 5).alias("ceiling"))


@query("margin_report", f"WITH {fused()}, k AS (SELECT *, CASE WHEN (d>0)=(y=1) THEN 1 ELSE 0 END ok, abs(d) sz FROM sc)" + f""", a AS {auc_sql('k', [], 'sz', 'ok')}, b AS {auc_sql('k', [], 'spread', '1-ok')}
 SELECT count(*) n, round(avg(ok),6) accuracy, round(avg(ok) FILTER (WHERE y=0),6) acc_real, round(avg(ok) FILTER (WHERE y=1),6) acc_fake, round((SELECT auc FROM a),6) auc_margin_correct, round((SELECT auc FROM b),6) auc_spread_error,
 round({quantile('sz', .5, 'ok=1')},6) median_correct, round({quantile('sz', .5, 'ok=0')},6) median_error FROM k""")
def _(spark, sf):
    r = E.margin_report(fused_scored(spark, sf))
    return r.select("n", *[r6(c) for c in r.columns if c != "n"])


@query("spread_pivot", f"WITH {fused()}, {fused('robust', 'rb')}, v AS (SELECT 'deploy' view, spread FROM sc UNION ALL SELECT 'robust', spread FROM rb), q AS (SELECT view, {quantile('spread', .5)} p50, {quantile('spread', .95)} p95, {quantile('spread', .99)} p99 FROM v GROUP BY 1), pv AS (SELECT max(p99) pv FROM q)"
       + " SELECT q.view, round(p50,6) p50, round(p95,6) p95, round(p99,6) p99, round(pv.pv,6) AS \"pivot\", (SELECT count(*) FROM v WHERE v.view=q.view AND spread>pv.pv) above FROM q, pv")
def _(spark, sf):
    v = fused_scored(spark, sf).unionByName(fused_scored(spark, sf, "robust")).select("view", "spread")
    return E.spread_pivot(v).select("view", r6("p50"), r6("p95"), r6("p99"), r6("pivot"), "above")


@query("paired_views", f"WITH {scored()}, {scored('robust', 'rb')} SELECT vec_id, round(sc.d1,6) deploy_1, round(rb.d1,6) robust_1 FROM sc JOIN rb USING (vec_id)")
def _(spark, sf):
    j = E.pair_views(B.scored(spark, sf), B.scored(spark, sf, "robust"), "vec_id")
    return j.select("vec_id", r6(F.element_at("d_deploy", 1), "deploy_1"), r6(F.element_at("d_robust", 1), "robust_1"))


@query("fused_margins", f"WITH {fused()} SELECT vec_id, round(d,6) margin, round(spread,6) spread FROM sc")
def _(spark, sf):
    return fused_scored(spark, sf).select("vec_id", r6("margin"), r6("spread"))


@query("logit_margins", f"WITH {scored()} SELECT vec_id, round(ln(exp(d2)+exp(d3))-d1,6) binary_margin, round(d3-d2,6) type_margin FROM sc")
def _(spark, sf):
    z = F.col("d")
    return B.scored(spark, sf).select("vec_id", r6(S.binary_margin(z), "binary_margin"), r6(S.type_margin(z), "type_margin"))


@query("row_seeds", "SELECT doc_id, (34*1000003+epoch*9176+doc_id)%2147483647 seed, CAST(epoch AS INT) epoch FROM documents, (SELECT unnest(range(3)) epoch)")
def _(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("epoch"))
    return d.select("doc_id", "epoch", S.epoch_row_seed(F.col("doc_id"), 34, F.col("epoch")).alias("seed"))


@query("unknown_branches", "SELECT DISTINCT event_type branch FROM events WHERE event_type NOT IN ('view','click')")
def _(spark, sf):
    known = rows(spark, "view;click", "branch string")
    return E.unknown_branches(B.table(spark, sf, "events").select(F.col("event_type").alias("branch")), F.broadcast(known))


HEAD = "SELECT dataset, mcc, br, mcc_a, br_a, (1+mcc)/2.0 acc, (1+mcc)/2.0*(1-(1+mcc)/2.0) fl, (1+mcc_a)/2.0 acca, (1+mcc_a)/2.0*(1-(1+mcc_a)/2.0) fla FROM j"


@query("headroom", f"WITH {fused()}, {fused('robust', 'rb')}, g AS (SELECT substr(dataset,7) dataset, y, {sigmoid('d')} p, 0 a FROM sc UNION ALL SELECT substr(dataset,7), y, {sigmoid('d')}, 1 FROM rb), z AS (SELECT dataset, a, {conf()} FROM g GROUP BY 1,2), zz AS (SELECT dataset, a, {MCC} mcc, br FROM z), j AS (SELECT p.dataset, p.mcc, p.br, q.mcc mcc_a, q.br br_a FROM zz p JOIN zz q ON p.dataset=q.dataset AND p.a=0 AND q.a=1), hd AS ({HEAD})"
       + f" SELECT dataset, round(acc,6) accuracy, round(fl,6) floor, round(greatest(br-fl,0),6) gap, round(0.8*{quality('mcc', 'br')}+0.2*{quality('mcc_a', 'br_a')},6) blended_now, round(0.8*{quality('mcc', 'fl')}+0.2*{quality('mcc_a', 'fla')},6) blended_ceiling FROM hd")
def _(spark, sf):
    def part(view, tag):
        s = fused_scored(spark, sf, view).withColumn("dataset", F.col("dataset").substr(7, 9))
        s = E.binary_scores(s, ["dataset"], "y", "p")
        return s.select("dataset", F.col("mcc").alias("mcc" + tag), F.col("brier").alias("brier" + tag))
    h = E.headroom(part("deploy", "").join(part("robust", "_aug"), "dataset"))
    return h.select("dataset", r6("accuracy"), r6("floor"), r6("gap"), r6("blended_now"), r6("blended_ceiling"))


@query("probability_losses", f"""WITH {fused()}, {fused('robust', 'rb')}, k AS (SELECT sc.dataset, sc.y, {sigmoid('sc.d')} p, {sigmoid('rb.d')} q FROM sc JOIN rb USING (vec_id)), t AS (SELECT *, y*CAST(0.9 AS DOUBLE)+0.05 tt FROM k)
 SELECT dataset, round(avg(-(tt*ln(p)+(1-tt)*ln(1-p))),6) cross_entropy, round(avg(((p-q)*(ln(p)-ln(q))+(q-p)*(ln(1-p)-ln(1-q)))/2),6) symmetric_kl, round(avg(pow(p-y,2)),6) brier FROM t GROUP BY 1""")
def _(spark, sf):
    a = fused_scored(spark, sf).select("vec_id", "dataset", "y", "p")
    b = fused_scored(spark, sf, "robust").select("vec_id", F.col("p").alias("q"))
    s = E.probability_losses(a.join(b, "vec_id"), ["dataset"], "y", "p", "q", 0.1)
    return s.select("dataset", r6("cross_entropy"), r6("symmetric_kl"), r6("brier"))


@query("screen_report", f"WITH {fused()} SELECT vec_id, round({sigmoid('d')},6) p, round((SELECT avg(CASE WHEN d>0 THEN 1.0 ELSE 0.0 END) FROM sc),6) share_fake FROM sc ORDER BY d DESC, vec_id LIMIT 20")
def _(spark, sf):
    return I.screen(fused_scored(spark, sf), "p", "vec_id").select("vec_id", r6("p"), r6("share_fake"))
