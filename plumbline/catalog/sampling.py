"""Queries over deterministic subsets, folds, sampling weights and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.operators import sampling as W
from plumbline.operators import units as U
from plumbline.catalog.base import r6, registrar
from plumbline.catalog.sqltext import MANIFEST, RAW, SPLIT, frac, scored

Q, SQL, query = registrar()

KB = {"real": 0.5, "synthetic": 0.25, "semisynthetic": 0.25}
BOOST_MARKER, BOOST = "src1", 5.0


def _quota(order_key, cap):
    return f""", c AS (SELECT dataset, label, greatest(1, round_even(count(*)*({cap}/CAST((SELECT count(*) FROM raw) AS DOUBLE)),0)) q FROM raw GROUP BY 1,2),
 r AS (SELECT image_id, dataset, label, row_number() OVER (PARTITION BY dataset, label ORDER BY {frac(order_key)}, image_id) rk FROM raw)
 SELECT image_id FROM r JOIN c USING (dataset, label) WHERE rk<=q"""


@query("eval_cap", "WITH " + RAW + _quota("concat('evalcap|',image_id)", 300))
def _(spark, sf):
    return W.eval_cap(B.raw_manifest(spark, sf), 300, B.SEED).select("image_id")


@query("stratified_sample", "WITH " + RAW + _quota("image_id", 200))
def _(spark, sf):
    return W.stratified_sample(B.raw_manifest(spark, sf), 200, B.SEED).select("image_id")


@query("random_subset", "WITH " + RAW + f" SELECT image_id FROM raw ORDER BY {frac('image_id')}, image_id LIMIT 100")
def _(spark, sf):
    return W.random_subset(B.raw_manifest(spark, sf), 100, B.SEED).select("image_id")


@query("pair_side_cap", "WITH " + SPLIT + f""", mx AS (SELECT split_unit FROM s GROUP BY 1 HAVING count(DISTINCT label)=2 AND count(*) FILTER (WHERE label=0)>=13),
 r AS (SELECT s.image_id, mx.split_unit IS NOT NULL in_pair, row_number() OVER (PARTITION BY s.split_unit, label ORDER BY {frac('image_id')}, image_id) rk FROM s LEFT JOIN mx ON s.split_unit=mx.split_unit)
 SELECT image_id, in_pair FROM r WHERE NOT in_pair OR rk<=10""")
def _(spark, sf):
    s = B.split_manifest(spark, sf, folded=False)
    mixed = U.mixed_units(s).filter("real_rows >= 13")
    return W.cap_sides(s, mixed, 10, B.SEED).select("image_id", "in_pair")


@query("blocked_folds", "WITH " + SPLIT + """, b AS (SELECT dataset AS block, count(*) n, avg(label)>=0.5 f FROM s GROUP BY 1)
 SELECT block, n, f mostly_fake, CAST((CASE WHEN f THEN 2 ELSE 0 END + row_number() OVER (PARTITION BY f ORDER BY n DESC, block)-1)%5 AS INT) fold FROM b""")
def _(spark, sf):
    return W.blocked_folds(B.split_manifest(spark, sf, folded=False), 5, "dataset")


@query("naive_folds", "WITH " + RAW + f" SELECT image_id, CAST(floor({frac('image_id')}*5) AS INT) fold FROM raw")
def _(spark, sf):
    return W.naive_folds(B.raw_manifest(spark, sf), 5, B.SEED).select("image_id", "fold")


@query("group_folds", "WITH " + RAW + """, g AS (SELECT DISTINCT source_path, label FROM raw),
 n AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY source_path)-1)%3 f FROM g)
 SELECT source_path, CAST(arg_min(f,label) AS INT) fold FROM n GROUP BY 1""")
def _(spark, sf):
    return W.group_folds(B.raw_manifest(spark, sf), "source_path", "label", 3)


# ---- weights ------------------------------------------------------------------------------------

def cells_sql(src: str, balance: bool = True, boost: float = 1.0) -> str:
    kind = "kind" if balance else "'_all_'"
    kb = "CASE kind WHEN 'real' THEN 0.5 WHEN 'synthetic' THEN 0.25 WHEN 'semisynthetic' THEN 0.25 ELSE 0 END" if balance else "1"
    return f""", bs AS (SELECT label, category, {kind} kind, grp, dataset, count(*) n FROM {src} GROUP BY ALL),
 g AS (SELECT label, category, kind, grp, sum(n) n, bool_or(contains(dataset,'{BOOST_MARKER}')) mk FROM bs GROUP BY ALL),
 qv AS (SELECT category, sqrt(CAST(r*f AS DOUBLE)) v FROM (SELECT category, count(DISTINCT dataset) FILTER (WHERE label=0) r, count(DISTINCT dataset) FILTER (WHERE label=1) f FROM bs GROUP BY 1) WHERE r>0 AND f>0),
 q AS (SELECT category, v/sum(v) OVER () q FROM qv),
 ks AS (SELECT label, category, sum(CAST({kb} AS DOUBLE)) tot, count(*) nk FROM (SELECT DISTINCT label, category, kind FROM g) GROUP BY 1,2),
 w0 AS (SELECT g.label, g.category, g.kind, grp, CAST(n AS BIGINT) n, coalesce(q,0) q, CAST(0.5 AS DOUBLE)*coalesce(q,0)*CASE WHEN nk<=1 OR tot<=0 THEN 1 ELSE CAST({kb} AS DOUBLE)/tot END
   *(gw/sum(gw) OVER (PARTITION BY g.label, g.category, g.kind))/n w
  FROM (SELECT *, sqrt(CAST(n AS DOUBLE))*CASE WHEN mk THEN CAST({boost} AS DOUBLE) ELSE 1 END gw FROM g) g JOIN ks USING (label, category) LEFT JOIN q ON q.category=g.category),
 w1 AS (SELECT * REPLACE (w/sum(w*n) OVER () AS w) FROM w0)"""


TRAIN = "WITH " + SPLIT + ", x AS (SELECT * FROM s WHERE split='train')"


def train(spark, sf):
    return B.split_manifest(spark, sf).filter("split = 'train'")


@query("cascade_weights", TRAIN + cells_sql("x", boost=BOOST) + " SELECT label, category, kind, grp AS \"group\", n, round(q,9) q, round(w,12) w FROM w1")
def _(spark, sf):
    c = W.cell_weights(train(spark, sf), kind_balance=KB, boost_marker=BOOST_MARKER, boost=BOOST)
    return c.select("label", "category", "kind", "group", "n", F.round("q", 9).alias("q"), F.round("w", 12).alias("w"))


@query("category_balance", "WITH " + MANIFEST + cells_sql("m", balance=False) + """ SELECT category, round(max(q),6) q, round(sum(w*n) FILTER (WHERE label=1)/sum(w*n),6) p_fake,
 abs(sum(w*n) FILTER (WHERE label=1)/sum(w*n)-0.5)>0.000001 off FROM w1 WHERE q>0 GROUP BY 1""")
def _(spark, sf):
    b = W.category_balance(W.cell_weights(B.manifest(spark, sf)))
    return b.select("category", r6("q"), r6("p_fake"), "off")


@query("kind_reach", TRAIN + cells_sql("x") + """, k AS (SELECT kind, label, sum(m) r, sum(q) qs FROM (SELECT kind, label, category, sum(w*n) m, max(q) q FROM w1 GROUP BY ALL) GROUP BY 1,2),
 t AS (SELECT kind, CASE kind WHEN 'real' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END target, r, 0.5*qs c FROM k)
 SELECT kind, target, round(r,6) realised, round(c,6) ceiling, CASE WHEN target>c+1e-9 THEN 'unreachable' WHEN abs(r-target)>0.02 THEN 'missed' ELSE 'met' END status FROM t""")
def _(spark, sf):
    k = W.kind_reach(W.cell_weights(train(spark, sf), kind_balance=KB), KB)
    return k.select("kind", "target", r6("realised"), r6("ceiling"), "status")


FILL = """, tier AS (SELECT w, sum(n) n FROM w1 GROUP BY 1),
 ab AS (SELECT w, coalesce(sum(n) OVER (ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) na, coalesce(sum(w*n) OVER (ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) ma FROM tier),
 cp AS (SELECT CAST({A} AS DOUBLE)/(SELECT sum(n) FROM w1) cap, (SELECT sum(n) FROM w1 WHERE w>0) served),
 lm AS (SELECT arg_max((1-cap*na)/(1-ma), w) lam FROM ab, cp WHERE w>0 AND (1-cap*na)/(1-ma)*w<=cap*(1+1e-12) AND (1-cap*na)/(1-ma)>0),
 w2 AS (SELECT w1.* REPLACE (CASE WHEN (SELECT max(w) FROM w1)<=cap THEN w WHEN w<=0 THEN 0 WHEN lam IS NULL OR served*cap<1 THEN CAST(1 AS DOUBLE)/served ELSE least(lam*w,cap) END AS w), (SELECT max(w) FROM w1)>cap cap_bound FROM w1, cp, lm)"""


@query("capped_weights", TRAIN + cells_sql("x", boost=BOOST) + FILL.format(A=2) + " SELECT label, category, kind, grp AS \"group\", n, round(w,12) w, cap_bound FROM w2")
def _(spark, sf):
    c = W.cap_weights(W.cell_weights(train(spark, sf), kind_balance=KB, boost_marker=BOOST_MARKER, boost=BOOST), 2.0)
    return c.select("label", "category", "kind", "group", "n", F.round("w", 12).alias("w"), "cap_bound")


@query("evenly_capped_weights", TRAIN + cells_sql("x", boost=BOOST) + FILL.format(A=0.9) + " SELECT label, category, kind, grp AS \"group\", n, round(w,12) w, cap_bound FROM w2")
def _(spark, sf):
    c = W.cap_weights(W.cell_weights(train(spark, sf), kind_balance=KB, boost_marker=BOOST_MARKER, boost=BOOST), 0.9)
    return c.select("label", "category", "kind", "group", "n", F.round("w", 12).alias("w"), "cap_bound")


@query("sampler_totals", TRAIN + cells_sql("x", boost=BOOST) + FILL.format(A=2) + """ SELECT round(sum(w*n) FILTER (WHERE label=1),6) p_fake, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) FILTER (WHERE w>0) AS BIGINT) servable,
 round(min(w) FILTER (WHERE w>0)*sum(n),6) amp_min, round(max(w)*sum(n),6) amp_max FROM w2""")
def _(spark, sf):
    c = W.cap_weights(W.cell_weights(train(spark, sf), kind_balance=KB, boost_marker=BOOST_MARKER, boost=BOOST), 2.0)
    return W.sampler_totals(c).select(r6("p_fake"), "rows", "servable", r6("amp_min"), r6("amp_max"))


ROWS_W = ", rw AS (SELECT x.*, w2.w FROM x JOIN w2 ON x.label=w2.label AND x.category=w2.category AND x.kind=w2.kind AND x.grp=w2.grp)"


@query("replay_diagnosis", TRAIN + cells_sql("x", boost=BOOST) + FILL.format(A=2) + ROWS_W + """ SELECT dataset, count(*) AS rows, round(sum(w),9) mass, round(max(w)*(SELECT count(*) FROM x),6) amp, min(kind) kind, min(category) category,
 max(w)*(SELECT count(*) FROM x)>=2-1e-6 at_cap FROM rw GROUP BY 1""")
def _(spark, sf):
    t = train(spark, sf)
    c = W.cap_weights(W.cell_weights(t, kind_balance=KB, boost_marker=BOOST_MARKER, boost=BOOST), 2.0)
    d = W.dataset_replay(W.weigh(t, c), 2.0, t.count())
    return d.select("dataset", "rows", F.round("mass", 9).alias("mass"), r6("amp"), "kind", "category", "at_cap")


@query("top_mass", TRAIN + cells_sql("x", boost=BOOST) + FILL.format(A=100) + ROWS_W + " SELECT dataset, round(sum(w),9) mass FROM rw GROUP BY 1 ORDER BY round(sum(w),9) DESC, dataset LIMIT 5")
def _(spark, sf):
    t = train(spark, sf)
    c = W.cap_weights(W.cell_weights(t, kind_balance=KB, boost_marker=BOOST_MARKER, boost=BOOST), 100.0)
    d = W.weigh(t, c).groupBy("dataset").agg(F.round(F.sum("w"), 9).alias("mass"))
    return d.orderBy(F.desc("mass"), "dataset").limit(5)


@query("batch_kind_weights", "WITH " + scored() + """, b AS (SELECT vec_id, vec_id//64 batch, y3 FROM sc)
 SELECT vec_id, round(count(*) OVER (PARTITION BY batch)/CAST(count(*) OVER (PARTITION BY batch, y3) AS DOUBLE)/k,9) kind_weight FROM b JOIN (SELECT batch, count(DISTINCT y3) k FROM b GROUP BY 1) USING (batch)""")
def _(spark, sf):
    s = B.scored(spark, sf).withColumn("batch", F.floor(F.col("vec_id") / 64))
    return W.batch_kind_weights(s, "batch", "y3").select("vec_id", F.round("kind_weight", 9).alias("kind_weight"))


# ---- draws --------------------------------------------------------------------------------------

EPOCH = 3
DRAWS = TRAIN + cells_sql("x") + f""", iv AS (SELECT *, round(sum(w*n) OVER (ORDER BY label, category, kind, grp ROWS UNBOUNDED PRECEDING),12) hi0 FROM w1 WHERE w>0),
 iv2 AS (SELECT *, coalesce(lag(hi0) OVER o,0) lo, CASE WHEN lead(hi0) OVER o IS NULL THEN 1 ELSE hi0 END hi FROM iv WINDOW o AS (ORDER BY label, category, kind, grp)),
 sl AS (SELECT slot, {frac('slot', f'{34}|{EPOCH}|cell')} u, {frac('slot', f'{34}|{EPOCH}|row')} v FROM (SELECT unnest(range((SELECT count(*) FROM x))) slot)),
 hit AS (SELECT slot, label, category, kind, grp, CAST(floor(v*n) AS BIGINT) row_no FROM sl JOIN iv2 ON u>=lo AND u<hi),
 nr AS (SELECT image_id, label, category, kind, grp, row_number() OVER (PARTITION BY label, category, kind, grp ORDER BY {frac('image_id', '34|order')}, image_id)-1 row_no FROM x),
 dr AS (SELECT slot, image_id FROM hit JOIN nr USING (label, category, kind, grp, row_no))"""


def draws(spark, sf, t, n):
    return W.weighted_draws(t, W.cell_weights(t, kind_balance=KB), n, B.SEED, EPOCH)


@query("weighted_draws", DRAWS + " SELECT slot, image_id FROM dr")
def _(spark, sf):
    t = train(spark, sf)
    return draws(spark, sf, t, t.count())


PAIRED = DRAWS + f""", np AS (SELECT count(*) n, CAST(count(*)*CAST(0.3 AS DOUBLE) AS BIGINT) FROM x), cnt AS (SELECT n, CAST(floor(n*CAST(0.3 AS DOUBLE)) AS BIGINT)//2 p FROM np),
 un AS (SELECT *, row_number() OVER (ORDER BY split_unit)-1 i FROM (SELECT split_unit, count(*) FILTER (WHERE label=0) r, count(*) FILTER (WHERE label=1) f FROM x GROUP BY 1) WHERE r>0 AND f>0),
 pj AS (SELECT pair, CAST(floor({frac('pair', f'34|{EPOCH}|unit')}*(SELECT count(*) FROM un)) AS BIGINT) i, {frac('pair', f'34|{EPOCH}|side0')} a, {frac('pair', f'34|{EPOCH}|side1')} b FROM (SELECT unnest(range((SELECT p FROM cnt))) pair)),
 want AS (SELECT pair*2 slot, split_unit, 0 label, CAST(floor(a*r) AS BIGINT) row_no FROM pj JOIN un USING (i) UNION ALL SELECT pair*2+1, split_unit, 1, CAST(floor(b*f) AS BIGINT) FROM pj JOIN un USING (i)),
 ur AS (SELECT image_id, split_unit, label, row_number() OVER (PARTITION BY split_unit, label ORDER BY {frac('image_id', '34|order')}, image_id)-1 row_no FROM x),
 pd AS (SELECT slot, image_id FROM want JOIN ur USING (split_unit, label, row_no)),
 al AS (SELECT * FROM (SELECT * FROM dr WHERE slot>=2*(SELECT p FROM cnt) UNION ALL SELECT * FROM pd) WHERE slot<(SELECT n-n%2 FROM cnt)),
 bo AS (SELECT block, row_number() OVER (ORDER BY {frac('block', f'34|{EPOCH}|block')}, block)-1 t FROM (SELECT unnest(range((SELECT n//2 FROM cnt))) block)),
 st AS (SELECT t*2+slot%2 slot, image_id FROM al JOIN bo ON block=slot//2)"""


def stream(spark, sf):
    t = train(spark, sf)
    n = t.count()
    n_pairs = int(n * 0.3) // 2
    d = W.mix_pairs(draws(spark, sf, t, n), W.pair_draws(t, n_pairs, B.SEED, EPOCH), n, n_pairs, B.SEED, EPOCH)
    return t, d


@query("paired_stream", PAIRED + " SELECT slot, image_id FROM st")
def _(spark, sf):
    return stream(spark, sf)[1]


@query("rank_slices", DRAWS + " SELECT image_id, CAST(slot%4 AS INT) AS rank, slot//4 AS place FROM dr")
def _(spark, sf):
    t = train(spark, sf)
    return W.by_rank(draws(spark, sf, t, t.count()), 4).select("image_id", "rank", "place")


@query("stream_totals", PAIRED + """, c AS (SELECT image_id, count(*) c FROM st GROUP BY 1) SELECT round(sum(c*label)/sum(c),6) p_fake, max(c) max_draws, count(*) distinct_rows, CAST(sum(c) AS BIGINT) draws FROM c JOIN x USING (image_id)""")
def _(spark, sf):
    t, d = stream(spark, sf)
    return W.stream_totals(d, t).withColumn("p_fake", F.round("p_fake", 6))


@query("stream_shift", PAIRED + """, rw AS (SELECT x.image_id, x.dataset, w FROM x JOIN w1 ON x.label=w1.label AND x.category=w1.category AND x.kind=w1.kind AND x.grp=w1.grp),
 c AS (SELECT image_id, count(*) c FROM st GROUP BY 1), t AS (SELECT dataset, sum(w) planned, coalesce(sum(c),0)/(SELECT count(*) FROM st) drawn FROM rw LEFT JOIN c USING (image_id) GROUP BY 1)
 SELECT dataset, round(planned,6) planned, round(drawn,6) drawn FROM t ORDER BY round(abs(drawn-planned),9) DESC, dataset LIMIT 3""")
def _(spark, sf):
    t, d = stream(spark, sf)
    w = W.weigh(t, W.cell_weights(t, kind_balance=KB))
    return W.stream_shift(d, w).select("dataset", r6("planned"), r6("drawn"))
