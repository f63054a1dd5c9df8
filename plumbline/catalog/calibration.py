"""Queries that fit temperatures, the type posterior and operating points."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.functions import scalar as S
from plumbline.operators import calibration as K
from plumbline.operators import evaluation as E
from plumbline.operators import sampling as W
from plumbline.catalog.base import r6, registrar
from plumbline.catalog.evaluation import both_views, composed, fused_scored, provenance_rows, SHARES
from plumbline.catalog.evaluation import BAL, MCC, WEIGHTED, conf, quality
from plumbline.catalog.sqltext import frac, fused, sigmoid
from plumbline.session import cut_lineage

Q, SQL, query = registrar()


def geo(lo, hi, n, i="i"):
    return f"CAST({lo} AS DOUBLE)*pow(CAST({hi / lo!r} AS DOUBLE),{i}/CAST({n - 1} AS DOUBLE))"


BOTH = f"{fused()}, {fused('robust', 'rb')}, v AS (SELECT 'base' view, * EXCLUDE (t) FROM sc UNION ALL SELECT 'aug', * EXCLUDE (t) FROM rb)"
GRID = f"gr AS (SELECT i, {geo(0.08, 8.0, 240)} t FROM (SELECT unnest(range(240)) i))"
ERR = "pow({p}-y,2)"


def _fit(groups="", src="v", name="ft"):
    """Temperature per group over rows of src(view, y, d)."""
    g = groups + ", " if groups else ""
    part = f"PARTITION BY {groups}" if groups else ""
    return f"""{name}_s AS (SELECT {g}view, i, t, y, avg({ERR.format(p=sigmoid('d/t'))}) e FROM {src}, gr GROUP BY ALL),
 {name}_b AS (SELECT {g}view, i, t, avg(e) b FROM {name}_s GROUP BY ALL),
 {name}_m AS (SELECT {g}i, t, coalesce(0.8*max(b) FILTER (WHERE view='base')+0.2*max(b) FILTER (WHERE view='aug'), max(b) FILTER (WHERE view='base')) b FROM {name}_b GROUP BY ALL),
 {name} AS (SELECT {g}CASE WHEN b>=0.245 THEN 1 ELSE t END temperature, b brier, i IN (0,239) at_edge, b>=0.245 no_signal FROM (SELECT *, row_number() OVER ({part} ORDER BY b, i) r FROM {name}_m) WHERE r=1)"""


@query("temperature", f"WITH {BOTH}, {GRID}, {_fit()} SELECT round(temperature,6) temperature, round(brier,6) brier, at_edge, no_signal FROM ft")
def _(spark, sf):
    return K.fit_temperature(both_views(spark, sf)).select(r6("temperature"), r6("brier"), "at_edge", "no_signal")


@query("dataset_temperatures", f"WITH {BOTH}, {GRID}, {_fit('dataset', '(SELECT substr(dataset,7) dataset, view, y, d FROM v)')} SELECT dataset, round(temperature,6) temperature, round(brier,6) brier, at_edge, no_signal FROM ft")
def _(spark, sf):
    v = both_views(spark, sf).withColumn("dataset", F.col("dataset").substr(7, 9))
    return K.fit_temperature(v, ["dataset"]).select("dataset", r6("temperature"), r6("brier"), "at_edge", "no_signal")


@query("spread_temperature", f"""WITH {BOTH}, gk AS (SELECT j, CASE WHEN j=0 THEN CAST(0 AS DOUBLE) ELSE {geo(1e-3, 2.0, 40, '(j-1)')} END k FROM (SELECT unnest(range(41)) j)),
 gt AS (SELECT i, {geo(0.08, 8.0, 80)} t FROM (SELECT unnest(range(80)) i)),
 s AS (SELECT view, j, k, i, t, y, avg({ERR.format(p=sigmoid('d/(1+k*spread)/t'))}) e FROM v, gk, gt GROUP BY ALL),
 b AS (SELECT view, j, k, i, t, avg(e) b FROM s GROUP BY ALL), m AS (SELECT j, k, i, t, 0.8*max(b) FILTER (WHERE view='base')+0.2*max(b) FILTER (WHERE view='aug') b FROM b GROUP BY ALL),
 x AS (SELECT * FROM m ORDER BY b, j, i LIMIT 1), z AS (SELECT * FROM m WHERE j=0 ORDER BY b, i LIMIT 1)
 SELECT round(x.t,6) temperature, round(x.k,6) slope, round(x.b,6) brier, round(z.t,6) scalar_temperature, round(z.b,6) scalar_brier, round(z.b-x.b,6) gain, x.i IN (0,79) OR x.j=40 at_edge FROM x, z""")
def _(spark, sf):
    r = K.fit_spread_temperature(both_views(spark, sf))
    return r.select(*[r6(c) for c in r.columns if c != "at_edge"], "at_edge")


@query("type_posterior", f"""WITH {fused()}, f AS (SELECT CASE WHEN y3=2 THEN 1 ELSE 0 END s, t m FROM sc WHERE y3>0), ga AS (SELECT i, {geo(0.25, 8.0, 60)} a FROM (SELECT unnest(range(60)) i)),
 gb AS (SELECT j, CAST(-6 AS DOUBLE)+7*j/CAST(56 AS DOUBLE) b FROM (SELECT unnest(range(57)) j)),
 e AS (SELECT i, a, j, b, s, avg(pow({sigmoid('m/a+b')}-s,2)) e FROM f, ga, gb GROUP BY ALL), w AS (SELECT i, a, j, b, sum(CASE s WHEN 1 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END*e) br FROM e GROUP BY ALL)
 SELECT round(a,6) type_temperature, round(b,6) type_bias, round(0.2*pow(CAST(0.999 AS DOUBLE),2)+0.8*pow(CAST(0.001 AS DOUBLE),2),6) brier_before, round(br,6) brier_after FROM w ORDER BY br, i, j LIMIT 1""")
def _(spark, sf):
    r = K.fit_type_margin(fused_scored(spark, sf), 0.2).drop("pinned")
    return r.select(*[r6(c) for c in r.columns])


CAPS = "[CAST(0.001 AS DOUBLE)," + ",".join(f"CAST({q!r} AS DOUBLE)" for q in K.linear(0.2, 0.95, 16) if q > 0.5 + 1e-6) + "]"
TYPE_PRIOR = 0.3
TYPE_FIT = f"""f AS (SELECT CASE WHEN y3=2 THEN 1 ELSE 0 END s, t m FROM sc WHERE y3>0), ga AS (SELECT i, {geo(0.25, 8.0, 60)} a FROM (SELECT unnest(range(60)) i)),
 gb AS (SELECT j, CAST(-6 AS DOUBLE)+7*j/CAST(56 AS DOUBLE) b FROM (SELECT unnest(range(57)) j)),
 tf AS (SELECT i, a, j, b, s, avg(pow({sigmoid('m/a+b')}-s,2)) e FROM f, ga, gb GROUP BY ALL),
 tb AS (SELECT i, a, j, b, sum(CASE s WHEN 1 THEN CAST({TYPE_PRIOR} AS DOUBLE) ELSE CAST({1 - TYPE_PRIOR} AS DOUBLE) END*e) br FROM tf GROUP BY ALL),
 fit AS (SELECT a, b, br FROM tb ORDER BY br, i, j LIMIT 1)"""
CAPPED = f"""WITH {fused()}, {TYPE_FIT}, gq AS (SELECT unnest({CAPS}) qm), th AS (SELECT qm, y3, {sigmoid('d')} pf, least(greatest({sigmoid('t/a+b')},CAST(0.001 AS DOUBLE)),qm) qq FROM sc, gq, fit),
 c3 AS (SELECT qm, y3, 1-pf p0, pf*(1-qq) p1, pf*qq p2 FROM th), n3 AS (SELECT y3, count(*) n FROM sc GROUP BY 1),
 w3 AS (SELECT c3.*, CASE WHEN p0>=p1 AND p0>=p2 THEN 0 WHEN p1>=p2 THEN 1 ELSE 2 END pd, CASE y3 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(0.35 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END/n w FROM c3 JOIN n3 USING (y3)),
 cm AS (SELECT qm, y3, pd, sum(w) w, sum(w*(pow(p0-(y3=0)::INT,2)+pow(p1-(y3=1)::INT,2)+pow(p2-(y3=2)::INT,2))) se FROM w3 GROUP BY ALL),
 tt AS (SELECT qm, y3 k, sum(w) t, sum(w) FILTER (WHERE pd=y3) h FROM cm GROUP BY ALL), pp AS (SELECT qm, pd k, sum(w) p FROM cm GROUP BY ALL),
 rk AS (SELECT tt.qm, coalesce(sum(h),0) hit, sum(t) s, sum(t*t) t2, sum(t*coalesce(p,0)) tp FROM tt LEFT JOIN pp ON tt.qm=pp.qm AND tt.k=pp.k GROUP BY 1),
 r2 AS (SELECT qm, sum(p*p) p2 FROM pp GROUP BY 1), rb2 AS (SELECT qm, sum(se)/sum(w) br FROM cm GROUP BY 1),
 fin AS (SELECT qm, CASE WHEN (s*s-p2)*(s*s-t2)>0 THEN (hit*s-tp)/sqrt((s*s-p2)*(s*s-t2)) ELSE 0 END g, br FROM rk JOIN r2 USING (qm) JOIN rb2 USING (qm)),
 sco AS (SELECT qm, {quality('g', 'br', '(CAST(2 AS DOUBLE)/3)')} sc FROM fin)"""


def cap_scores(spark, sf):
    rows = fused_scored(spark, sf)
    fit = cut_lineage(K.fit_type_margin(rows, TYPE_PRIOR))
    return K.type_cap_scores(rows, TYPE_PRIOR, fit.select("type_temperature").scalar(), fit.select("type_bias").scalar(), "p")


@query("type_cap_scores", CAPPED + " SELECT round(qm,6) q_max, round(sc,6) score FROM sco")
def _(spark, sf):
    return cap_scores(spark, sf).select(r6("q_max"), r6("score"))


CHOSEN = ", bb AS (SELECT (SELECT sc FROM sco WHERE qm=0.001) b0, qm, sc FROM sco WHERE qm<>0.001 ORDER BY round(sc,9) DESC, qm LIMIT 1), ch AS (SELECT CASE WHEN sc>b0 THEN qm ELSE CAST(0.001 AS DOUBLE) END q_max, b0 score_before, greatest(sc,b0) score_after FROM bb)"


@query("type_cap_choice", CAPPED + CHOSEN + " SELECT round(q_max,6) q_max, round(score_before,6) score_before, round(score_after,6) score_after FROM ch")
def _(spark, sf):
    return K.pick_cap(cap_scores(spark, sf)).select(r6("q_max"), r6("score_before"), r6("score_after"))


@query("type_posterior_chain", CAPPED + CHOSEN + """ SELECT round(a,6) type_temperature, round(b,6) type_bias, round(q_max,6) q_max, round(br,6) brier_after, round(score_before,6) score_before, round(score_after,6) score_after, false pinned FROM fit, ch""")
def _(spark, sf):
    r = K.fit_type_posterior(fused_scored(spark, sf), TYPE_PRIOR, "p")
    return r.select(*[r6(c) for c in ("type_temperature", "type_bias", "q_max", "brier_after", "score_before", "score_after")], "pinned")


_STAGES = f"""SELECT 'raw' stage, y3, {sigmoid('d')} pf, {sigmoid('t')} q FROM sc UNION ALL SELECT 'calibrated', y3, {sigmoid('d')}, least(greatest({sigmoid('t/a+b')},CAST(0.001 AS DOUBLE)),q_max) FROM sc, fit, ch
 UNION ALL SELECT 'pinned', y3, {sigmoid('d')}, CAST(0.001 AS DOUBLE) FROM sc"""


@query("type_effects", CAPPED + CHOSEN + f""", st AS ({_STAGES}), s3 AS (SELECT stage, y3, 1-pf p0, pf*(1-q) p1, pf*q p2 FROM st), s4 AS (SELECT *, CASE WHEN p0>=p1 AND p0>=p2 THEN 0 WHEN p1>=p2 THEN 1 ELSE 2 END told FROM s3)
 SELECT stage, {', '.join(f"round(avg((told={k})::INT) FILTER (WHERE y3={k}),6) recall_{n}" for k, n in enumerate(('real', 'synthetic', 'semisynthetic')))}, count(*) FILTER (WHERE told=2) semi_predicted FROM s4 GROUP BY 1""")
def _(spark, sf):
    rows = fused_scored(spark, sf)
    fit = cut_lineage(K.fit_type_posterior(rows, TYPE_PRIOR, "p"))
    of = lambda c: fit.select(c).scalar()
    e = K.type_effects(rows, of("type_temperature"), of("type_bias"), of("q_max"), "p")
    return e.select("stage", r6("recall_real"), r6("recall_synthetic"), r6("recall_semisynthetic"), "semi_predicted")


FOLDS = """g AS (SELECT DISTINCT dataset, y FROM sc), fo AS (SELECT dataset, arg_min(f,y) fold FROM (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY dataset)-1)%2 f FROM g) GROUP BY 1),
 vf AS (SELECT 1-fold fold, view, y, d FROM v JOIN fo USING (dataset))"""
XFIT = f"WITH {BOTH}, {GRID}, {FOLDS}, {_fit('fold', 'vf')}, {_fit('', 'v', 'fl')}, rt AS (SELECT max(temperature)/min(temperature) ra FROM ft), fin AS (SELECT fold, ra, ft.temperature fitted, fl.temperature pooled, CASE WHEN ra>2 THEN fl.temperature ELSE ft.temperature END temperature FROM ft, fl, rt)"


def folded_views(spark, sf):
    v = both_views(spark, sf)
    folds = W.group_folds(v, "dataset", "y", 2)
    return v.join(folds, "dataset")


@query("crossfit_temperatures", XFIT + " SELECT CAST(fold AS INT) fold, round(ra,6) fold_ratio, round(fitted,6) fitted, round(pooled,6) pooled, round(temperature,6) temperature FROM fin")
def _(spark, sf):
    r = K.crossfit_temperatures(folded_views(spark, sf), "fold", group="dataset")
    return r.select("fold", r6("fold_ratio"), r6("fitted"), r6("pooled"), r6("temperature"))


@query("crossfit_scores", XFIT + f", a0 AS (SELECT view, y, {sigmoid('d/temperature')} p FROM v JOIN fo USING (dataset) JOIN fin USING (fold)), {BAL.replace('FROM v ', 'FROM a0 ')} SELECT view, round({MCC},6) mcc, round(br,6) brier, round({quality(MCC, 'br')},6) score FROM b")
def _(spark, sf):
    v = folded_views(spark, sf)
    t = K.crossfit_temperatures(v, "fold", group="dataset").select("fold", "temperature")
    s = v.join(t, "fold").withColumn("p", S.sigmoid(F.col("margin") / F.col("temperature")))
    return E.balanced_scores(s, ["view"], "y", "p").select("view", r6("mcc"), r6("brier"), r6("score"))


POOLS = f"{fused()}, {fused('robust', 'rb')}, v AS (SELECT 'local' pool, * EXCLUDE (t) FROM sc UNION ALL SELECT 'hidden', * EXCLUDE (t) FROM rb)"


def pools(spark, sf):
    return both_views(spark, sf).withColumn("pool", F.when(F.col("view") == "base", "local").otherwise("hidden"))


@query("mixture_temperature", f"""WITH {POOLS}, {GRID}, s AS (SELECT pool, i, t, y, avg({ERR.format(p=sigmoid('d/t'))}) e FROM v, gr GROUP BY ALL), b AS (SELECT pool, i, t, avg(e) b FROM s GROUP BY ALL),
 m AS (SELECT i, t, max(b) FILTER (WHERE pool='local') l, max(b) FILTER (WHERE pool='hidden') h FROM b GROUP BY ALL)
 SELECT round(t,6) temperature, round(0.7*l+0.3*h,6) brier, round(l,6) brier_local, round(h,6) brier_hidden FROM m ORDER BY 0.7*l+0.3*h, i LIMIT 1""")
def _(spark, sf):
    r = K.mixture_temperature(pools(spark, sf), "pool", {"local": 0.7, "hidden": 0.3})
    return r.select(*[r6(c) for c in r.columns])


SWEEP = f"""WITH {POOLS}, gr AS (SELECT i, CASE WHEN i=121 THEN CAST(0.9 AS DOUBLE) ELSE {geo(0.2, 6.0, 121)} END t FROM (SELECT unnest(range(122)) i)), s AS (SELECT pool, i, t, y, avg({ERR.format(p=sigmoid('d/t'))}) e FROM v, gr GROUP BY ALL), b AS (SELECT pool, i, t, avg(e) b FROM s GROUP BY ALL),
 m AS (SELECT i, t, 0.7*max(b) FILTER (WHERE pool='local')+0.3*max(b) FILTER (WHERE pool='hidden') b FROM b GROUP BY ALL), bs AS (SELECT * FROM m WHERE i<121 ORDER BY b, i LIMIT 1), nr AS (SELECT b nb FROM m WHERE i<121 ORDER BY abs(t-0.9), i LIMIT 1), cu AS (SELECT b cb FROM m WHERE i=121),
 f AS (SELECT t, 0.2-cb anchor, b+0.2-cb pb, nb-b gain, abs(0.2-cb)/2 noise FROM bs, nr, cu)"""


@query("headroom_sweep", SWEEP + f" SELECT round(t,6) temperature, round(anchor,6) anchor, round(pb,6) predicted_brier, round(gain,6) brier_gain, round({quality('0.5', 'greatest(pb,0)')}-{quality('0.5', 'CAST(0.2 AS DOUBLE)')},6) score_gain, round(noise,6) noise, gain>greatest(noise,0.002) confident FROM f")
def _(spark, sf):
    r = K.anchored_sweep(pools(spark, sf), "pool", "local", "hidden", observed_mcc=0.5, observed_brier=0.2, current=0.9)
    return r.select(*[r6(c) for c in r.columns if c != "confident"], "confident")


LG = "ln(least(greatest(p,1e-7),1-1e-7)/(1-least(greatest(p,1e-7),1-1e-7)))"
_lits = lambda xs: "[" + ",".join(f"CAST({x!r} AS DOUBLE)" for x in xs) + "]"
POINTS = WEIGHTED + f""", {fused('robust', 'rb')}, wd AS (SELECT dataset, max(w) w FROM wt GROUP BY 1),
 u AS (SELECT 'base' view, y, {LG} l, w FROM wt UNION ALL SELECT 'aug', y, {LG.replace('p,', 'q,')}, w FROM (SELECT rb.y, {sigmoid('rb.d')} q, wd.w FROM rb JOIN wd USING (dataset))),
 st AS (SELECT t, lo, hi FROM (SELECT unnest({_lits(K.T_MULT)}) t), (SELECT unnest({_lits(K.P_MIN)}) lo), (SELECT unnest({_lits(K.P_MAX)}) hi)),
 ap AS (SELECT view, t, lo, hi, y, w, least(greatest(1/(1+exp(-l/t)),lo),hi) p FROM u, st), a AS (SELECT view, t, lo, hi, {conf('w')} FROM ap GROUP BY view, t, lo, hi),
 q AS (SELECT view, t, lo, hi, {MCC} mcc, {quality(MCC, 'br')} s FROM a),
 pt AS (SELECT t, lo, hi, 0.8*max(s) FILTER (WHERE view='base')+0.2*max(s) FILTER (WHERE view='aug') bl FROM q GROUP BY 1,2,3)"""


def scenario_rows(spark, sf):
    base = E.share_weights(provenance_rows(spark, sf), "cls", SHARES)
    aug = E.carry_weights(fused_scored(spark, sf, "robust"), base, "dataset")
    keep = ["view", "y", F.col("p").alias("p_fake"), "weight"]
    return base.withColumn("view", F.lit("base")).select(*keep).unionByName(
        aug.withColumn("view", F.lit("aug")).select(*keep)).withColumn("scenario", F.lit("clean"))


@query("operating_points", POINTS + " SELECT round(t,6) t, round(lo,6) p_min, round(hi,6) p_max, round(bl,6) blended FROM pt")
def _(spark, sf):
    return K.operating_points(scenario_rows(spark, sf)).select(r6("t"), r6("p_min"), r6("p_max"), r6("blended"))


@query("operating_choice", POINTS + f", gn AS (SELECT t, lo, hi, round(bl-(SELECT bl FROM pt WHERE t=1 AND lo=CAST(1e-6 AS DOUBLE) AND hi=CAST({K.P_MAX[0]!r} AS DOUBLE)),12) g FROM pt) SELECT round(t,6) t, round(lo,6) p_min, round(hi,6) p_max, round(g,6) min_gain FROM gn WHERE g>=-0.002 ORDER BY g DESC, t, lo, hi DESC LIMIT 1")
def _(spark, sf):
    return K.recommend(K.operating_points(scenario_rows(spark, sf)), "clean").select(r6("t"), r6("p_min"), r6("p_max"), r6("min_gain"))


def _drawn(y, lo, hi, pool, p):
    """Slots lo to hi drawn from a pool: the row whose place by hash is the slot's own hashed choice."""
    tag = f"{B.SEED}|{y}|', CAST({lo} AS BIGINT), '"
    return f"""SELECT {y} y, slot, {p} p FROM (SELECT slot, least(CAST(floor({frac('slot', tag)}*(SELECT count(*) FROM {pool})) AS BIGINT),(SELECT count(*) FROM {pool})-1) at_ FROM nn, unnest(range(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT))) t(slot)) s
 JOIN (SELECT p, row_number() OVER (ORDER BY {frac('vec_id', tag)}, vec_id)-1 at_ FROM {pool}, nn) r USING (at_)"""


_HIDDEN = f"""WITH {fused()}, own AS (SELECT vec_id, y, {sigmoid('d')} p FROM sc), own1 AS (SELECT * FROM own WHERE y=1), own0 AS (SELECT * FROM own WHERE y=0), wrong AS (SELECT * FROM own WHERE y=1 AND p<0.5),
 nn AS (SELECT count(*) FILTER (WHERE y=1) n1, count(*) FILTER (WHERE y=0) n0, round_even(count(*) FILTER (WHERE y=1)*0.1::DOUBLE,0) w1, round_even(count(*) FILTER (WHERE y=0)*0.1::DOUBLE,0) w0 FROM own)
 SELECT y, slot, round(p,6) p_fake FROM ({_drawn(1, 0, 'w1', 'wrong', 'p')} UNION ALL {_drawn(1, 'w1', 'n1', 'own1', 'p')} UNION ALL {_drawn(0, 0, 'w0', 'wrong', '1-p')} UNION ALL {_drawn(0, 'w0', 'n0', 'own0', 'p')})"""


@query("scenario_pool", _HIDDEN)
def _(spark, sf):
    """The hidden class of the inverted scenario: every draw of it."""
    own = fused_scored(spark, sf).select("vec_id", "y", F.col("p").alias("p_fake"))
    pool = K.scenario_pool(own, 0.1, B.SEED, own.filter("y = 1").count(), own.filter("y = 0").count(), own.filter("y = 1 and p_fake < 0.5"))
    return pool.select("y", "slot", r6("p_fake"))


@query("scenario_points")
def _(spark, sf):
    """Scenario pools beside the plain one: a clean and an inverted hidden class as large as the table."""
    own = fused_scored(spark, sf).select("vec_id", "y", F.col("p").alias("p_fake"))
    n1, n0 = own.filter("y = 1").count(), own.filter("y = 0").count()
    wrong = own.filter("y = 1 and p_fake < 0.5")
    out = None
    base = provenance_rows(spark, sf).select("dataset", "y", "cls", F.col("p").alias("p_fake"))
    for share in (0.0, 0.1):
        pool = K.scenario_pool(own, share, B.SEED, n1, n0, wrong).withColumn("cls", S.provenance(F.col("dataset"), B.STREAM_MARKER))
        both = E.share_weights(base.unionByName(pool.select(*base.columns)), "cls", SHARES)
        aug = E.carry_weights(fused_scored(spark, sf, "robust"), both, "dataset").select(F.lit("aug").alias("view"), "y", F.col("p").alias("p_fake"), "weight")
        s = both.select(F.lit("base").alias("view"), "y", "p_fake", "weight").unionByName(aug).withColumn("scenario", F.lit(f"inv-{share}"))
        out = s if out is None else out.unionByName(s)
    return K.recommend(K.operating_points(out), "inv-0.0").select(r6("t"), r6("p_min"), r6("p_max"), r6("min_gain"))


@query("parity_gate", f"WITH {fused()}, pr AS (SELECT dataset, y, {sigmoid('d')} p FROM sc), a AS (SELECT substr(dataset,7) part, {conf()} FROM pr GROUP BY 1), s AS (SELECT part, {quality(MCC, 'br')} score FROM a) SELECT part, round(score,6) score, round(abs(score-0.3),6) drift, abs(score-0.3)>0.05 failed FROM s")
def _(spark, sf):
    s = E.binary_scores(fused_scored(spark, sf).withColumn("part", F.col("dataset").substr(7, 9)), ["part"], "y", "p").select("part", "score")
    recorded = s.select("part", F.lit(0.3).alias("recorded"))
    return K.parity(s, recorded, ["part"], 0.05).select("part", r6("score"), r6("drift"), "failed")


def newton(source, by="", keep=""):
    """Steps of Newton's method for (a, b) of a sigmoid over source(y, d); ``by`` is a grouping column."""
    g = by + ", " if by else ""
    return f"""(SELECT {g.replace(by, "it." + by) if by else ""}i+1 i, a+(h22*g1-h12*g2)/(h11*h22-h12*h12) a, b+(h11*g2-h12*g1)/(h11*h22-h12*h12) b FROM (SELECT {g}i, a, b, sum((y-p)*d) g1, sum(y-p) g2,
  sum(p*(1-p)*d*d) h11, sum(p*(1-p)*d) h12, sum(p*(1-p)) h22 FROM (SELECT {("it." + by + ", ") if by else ""}it.i, it.a, it.b, x.y, x.d, 1/(1+exp(-(it.a*x.d+it.b))) p FROM it, {source} x WHERE it.i<25{keep}) GROUP BY {g}i, a, b) it)"""


def r4(c):
    return F.round(c, 4).alias(c)


PLATT = f"""WITH RECURSIVE {fused()}, it AS (SELECT 0 i, CAST(0 AS DOUBLE) a, CAST(0 AS DOUBLE) b UNION ALL {newton("sc")}), ab AS (SELECT a, b FROM it ORDER BY i DESC LIMIT 1),
 v AS (SELECT 'all' view, y, {sigmoid("a*d+b")} p FROM sc, ab), {BAL}"""


@query("platt_scores", PLATT + f" SELECT n, round(tp+tn,4) accuracy, round({MCC},4) mcc, round(br,4) brier, round({quality(MCC, 'br')},4) score FROM b")
def _(spark, sf):
    s = fused_scored(spark, sf)
    a, b = K.fit_platt(s)
    s = s.withColumn("p", S.sigmoid(F.lit(a) * F.col("margin") + F.lit(b)))
    return E.balanced_scores(s, [], "y", "p").select("n", r4("accuracy"), r4("mcc"), r4("brier"), r4("score"))


XPLATT = f"""WITH RECURSIVE {fused()}, g AS (SELECT DISTINCT dataset, y FROM sc), fo AS (SELECT dataset, arg_min(f,y) fold FROM (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY dataset)-1)%2 f FROM g) GROUP BY 1),
 sf AS (SELECT sc.*, fold FROM sc JOIN fo USING (dataset)),
 it AS (SELECT fold, 0 i, CAST(0 AS DOUBLE) a, CAST(0 AS DOUBLE) b FROM (SELECT DISTINCT fold FROM fo) UNION ALL {newton("sf", "fold", " AND x.fold<>it.fold")}), ab AS (SELECT fold, a, b FROM it WHERE i=25),
 v AS (SELECT 'all' view, y, {sigmoid("a*d+b")} p FROM sf JOIN ab USING (fold)), {BAL}"""


@query("crossfit_platt_scores", XPLATT + f" SELECT n, round(tp+tn,4) accuracy, round({MCC},4) mcc, round(br,4) brier, round({quality(MCC, 'br')},4) score FROM b")
def _(spark, sf):
    s = fused_scored(spark, sf)
    s = s.join(W.group_folds(s, "dataset", "y", 2), "dataset")
    s = K.apply_platt(s, K.crossfit_platt(s, "fold", 2), "fold", out="p")
    return E.balanced_scores(s, [], "y", "p").select("n", r4("accuracy"), r4("mcc"), r4("brier"), r4("score"))


CKPT = f"""WITH {fused()}, ck AS (SELECT concat('step-',CAST(c AS VARCHAR)) checkpoint, CASE WHEN vec_id%3=0 THEN 'val_id' WHEN vec_id%3=1 THEN 'val_xgen' ELSE 'val_stress' END split, 'base' view, y, CASE WHEN vec_id%7<c THEN -d ELSE d END d FROM sc, (SELECT unnest(range(1,4)) c)),
 {GRID}, {_fit('checkpoint, split', 'ck')}, a0 AS (SELECT checkpoint, split, y, {sigmoid('d/temperature')} p FROM ck JOIN ft USING (checkpoint, split)), {BAL.replace('FROM v ', 'FROM a0 ').replace('view', 'checkpoint, split').replace('GROUP BY 1', 'GROUP BY 1,2')},
 q AS (SELECT checkpoint, split, {quality(MCC, 'br')} s, CASE split WHEN 'val_id' THEN 0.7 WHEN 'val_xgen' THEN 0.3 ELSE 0 END w FROM b), z AS (SELECT checkpoint, sum(w*s)/sum(w) sel FROM q GROUP BY 1)"""


@query("checkpoint_selection", CKPT + " SELECT checkpoint, round(sel,6) selection, row_number() OVER (ORDER BY round(sel,9) DESC, checkpoint)=1 best FROM z")
def _(spark, sf):
    s = fused_scored(spark, sf)
    k = F.col("vec_id")
    split = F.when(k % 3 == 0, "val_id").when(k % 3 == 1, "val_xgen").otherwise("val_stress")
    c = s.select("vec_id", "y", "margin", split.alias("split"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("c"))
    c = c.select(F.concat(F.lit("step-"), F.col("c").cast("string")).alias("checkpoint"), "split", F.lit("base").alias("view"), "y",
                 F.when(F.col("vec_id") % 7 < F.col("c"), -F.col("margin")).otherwise(F.col("margin")).alias("margin"))
    keys = ["checkpoint", "split"]
    t = K.fit_temperature(c, keys).select(*keys, "temperature")
    scored = c.join(t, keys).withColumn("p", S.sigmoid(F.col("margin") / F.col("temperature")))
    sel = K.select_checkpoint(E.balanced_scores(scored, keys, "y", "p"), {"val_id": 0.7, "val_xgen": 0.3})
    return sel.select("checkpoint", r6("selection"), "best")
