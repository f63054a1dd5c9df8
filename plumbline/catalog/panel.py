"""Queries that compare result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.operators import panel as C
from plumbline.sources import metadata as MD
from plumbline.catalog.base import r6, registrar
from plumbline.catalog.sqltext import quantile, tallies

Q, SQL, query = registrar()

TWO = f"{tallies('event_id%2=0', 'ra')}, {tallies('event_id%2=1', 'rl')}"


def _tally(src, name, keys=""):
    return f"""{name} AS (SELECT {keys}truth, dataset, CAST(sum(n) AS BIGINT) n, CAST(coalesce(sum(n) FILTER (WHERE pred_label=truth),0) AS BIGINT) k,
 CAST(coalesce(sum(n) FILTER (WHERE (pred_label='real')=(truth='real')),0) AS BIGINT) b FROM {src} GROUP BY ALL)"""


def halves(spark, sf):
    return B.tallies(spark, sf, "event_id % 2 = 0"), B.tallies(spark, sf, "event_id % 2 = 1")


@query("tallies", f"WITH {tallies()}, {_tally('psa', 't')} SELECT truth, dataset, n, k exact, b \"right\" FROM t")
def _(spark, sf):
    return C.tally(B.tallies(spark, sf))


CMP = f"""WITH {TWO}, {_tally('ra', 'a')}, {_tally('rl', 'l')}, c AS (SELECT a.dataset, a.truth, a.truth<>l.truth truth_differs, a.n n_ref, l.n n_local, a.k*100.0/a.n acc_ref, l.k*100.0/l.n acc_local,
 a.b*100.0/a.n right_ref, l.b*100.0/l.n right_local, (a.k+l.k)/CAST(a.n+l.n AS DOUBLE) p, a.k ka, l.k kl FROM a JOIN l USING (dataset)),
 z AS (SELECT *, sqrt(p*(1-p)*(1.0/n_ref+1.0/n_local)) se FROM c),
 y AS (SELECT *, CASE WHEN se=0 THEN 0 ELSE (CAST(kl AS DOUBLE)/n_local-CAST(ka AS DOUBLE)/n_ref)/se END z, acc_local-acc_ref delta,
  CASE WHEN contains(dataset,'-holdout-') THEN 'holdout' WHEN contains(dataset,'stream-') THEN 'stream' ELSE 'public' END provenance FROM z)"""


@query("compare_runs", CMP + " SELECT dataset, truth, provenance, truth_differs, n_ref, n_local, round(acc_ref,6) acc_ref, round(acc_local,6) acc_local, round(right_ref,6) right_ref, round(right_local,6) right_local, round(z,6) z, round(delta,6) delta FROM y")
def _(spark, sf):
    c = C.compare(*halves(spark, sf), B.STREAM_MARKER)
    return c.select("dataset", "truth", "provenance", "truth_differs", "n_ref", "n_local", *[r6(x) for x in ("acc_ref", "acc_local", "right_ref", "right_local", "z", "delta")])


@query("comparison_summary", CMP + f""" SELECT count(*) datasets, round(max(abs(delta)),6) max_delta, round(corr(acc_ref,acc_local),6) pearson, count(*) FILTER (WHERE abs(z)>=1) flagged,
 count(*) FILTER (WHERE acc_ref<30 OR acc_local<30) informative, count(*) FILTER (WHERE (acc_ref<30 OR acc_local<30) AND abs(z)>=1) informative_flagged, round({quantile('abs(delta)', .5)},6) median_delta FROM y""")
def _(spark, sf):
    s = C.comparison_summary(C.compare(*halves(spark, sf), B.STREAM_MARKER), z_flag=1.0, informative_below=30.0)
    return s.select("datasets", r6("max_delta"), r6("pearson"), "flagged", "informative", "informative_flagged", r6("median_delta"))


@query("common_datasets", f"WITH {TWO} SELECT DISTINCT ra.dataset FROM ra SEMI JOIN rl ON ra.dataset=rl.dataset")
def _(spark, sf):
    a, b = halves(spark, sf)
    return a.select("dataset").intersect(b.select("dataset"))


@query("missing_names", f"WITH {TWO} SELECT DISTINCT concat(event_type,'-set') name FROM events")
def _(spark, sf):
    names = B.table(spark, sf, "events").select(F.concat("event_type", F.lit("-set")).alias("name")).distinct()
    a, b = halves(spark, sf)
    return C.missing_names(names.union(a.select("dataset").distinct()), a, b)


SHARES = """, p AS (SELECT truth, n, CASE WHEN contains(dataset,'-holdout-') THEN 'holdout' WHEN contains(dataset,'stream-') THEN 'stream' ELSE 'public' END cls FROM psa),
 c AS (SELECT cls, CAST(sum(n) AS DOUBLE) n, CASE cls WHEN 'public' THEN 0.5 WHEN 'holdout' THEN 0.35 ELSE 0.15 END s FROM p GROUP BY 1),
 w AS (SELECT cls, s/sum(s) OVER ()*sum(n) OVER ()/n w FROM c), g AS (SELECT truth, sum(n) raw, sum(n*w) mass FROM p JOIN w USING (cls) GROUP BY 1),
 sh AS (SELECT truth, raw/sum(raw) OVER () r, mass/sum(mass) OVER () m FROM g)"""
COMPOSITION = {"public": 0.50, "holdout": 0.35, "stream": 0.15}


@query("deploy_prior", f"WITH {tallies()}{SHARES} SELECT truth, round(r,6) raw_share, round(m,6) weighted_share FROM sh")
def _(spark, sf):
    return C.deploy_prior_shares(B.tallies(spark, sf), COMPOSITION, B.STREAM_MARKER).select("truth", r6("raw_share"), r6("weighted_share"))


@query("semi_given_fake", f"WITH {tallies()}{SHARES} SELECT round(sum(m) FILTER (WHERE truth='semisynthetic')/sum(m) FILTER (WHERE truth<>'real'),6) semi_given_fake FROM sh")
def _(spark, sf):
    s = C.deploy_prior_shares(B.tallies(spark, sf), COMPOSITION, B.STREAM_MARKER)
    return C.semi_given_fake(s).select(r6("semi_given_fake"))


def models(spark, sf):
    """Four models, each with a reference and a local run."""
    name = F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string"))
    return B.tallies(spark, sf, "event_id % 8 < 4", name), B.tallies(spark, sf, "event_id % 8 >= 4", name)


def _by_model(shift, name):
    raw = tallies("TRUE", "inner_psa").replace("inner_psa AS (SELECT ", f"{name} AS (SELECT concat('m',CAST(event_id%8-{shift} AS VARCHAR)) model, ")
    return raw.replace("WHERE TRUE GROUP BY 1,2,3", f"WHERE event_id%8 BETWEEN {shift} AND {shift + 3} GROUP BY 1,2,3,4")


RANKS = f"""WITH {_by_model(0, 'mr')}, {_by_model(4, 'ml')}, {_tally('mr', 'tr', 'model, ')}, {_tally('ml', 'tl', 'model, ')},
 tg AS (SELECT model, k, n, dataset FROM tr WHERE contains(dataset,'-holdout-') AND truth='real' AND dataset IN (SELECT dataset FROM tr GROUP BY 1 HAVING count(DISTINCT model)=4)),
 t AS (SELECT model, dataset target, round(k*100.0/n,9) acc FROM tg UNION ALL SELECT model, 'POOLED', round(sum(k)*100.0/sum(n),9) FROM tg GROUP BY 1),
 l AS (SELECT model, dataset, truth, round(k*100.0/n,9) acc FROM tl WHERE dataset IN (SELECT dataset FROM tl GROUP BY 1 HAVING count(DISTINCT model)=4)),
 rt AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY acc)+(count(*) OVER (PARTITION BY target, acc)-1)/2.0 r FROM t),
 rl AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY acc)+(count(*) OVER (PARTITION BY dataset, acc)-1)/2.0 r FROM l),
 pr AS (SELECT rl.dataset, rl.truth, rt.target, CASE WHEN stddev_pop(rl.r)=0 OR stddev_pop(rt.r)=0 THEN NULL ELSE corr(rl.r, rt.r) END rho, max(rl.acc)-min(rl.acc) rg FROM rl JOIN rt USING (model) GROUP BY ALL)"""


def ranked(spark, sf):
    ref, loc = models(spark, sf)
    targets = C.shared_by_all(ref).join(
        ref.filter("truth = 'real' and contains(dataset, '-holdout-')").select("dataset").distinct(), "dataset", "left_semi")
    return C.rank_against_targets(loc, ref, targets)


@query("rank_against_targets", RANKS + ' SELECT dataset, truth, target, round(rho,6) rho, round(rg,6) "range" FROM pr')
def _(spark, sf):
    return ranked(spark, sf).select("dataset", "truth", "target", r6("rho"), r6("range"))


@query("rank_candidates", RANKS + ' SELECT dataset, round(rho,6) rho, round(rg,6) "range" FROM pr WHERE target=\'POOLED\' AND rg>=1 AND round(rho,9)>=0.8')
def _(spark, sf):
    return C.rank_candidates(ranked(spark, sf), 1.0).select("dataset", r6("rho"), r6("range"))


@query("rank_table", RANKS + ' SELECT dataset, round(rho,6) rho, round(rg,6) "range" FROM pr WHERE target=\'POOLED\' ORDER BY 2 DESC NULLS LAST, 3 DESC, 1')
def _(spark, sf):
    return C.rank_table(ranked(spark, sf)).select("dataset", r6("rho"), r6("range"))
