"""Queries over view plans and generation plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.plans import jobs as J
from plumbline.plans import views as V
from plumbline.catalog.base import r6, registrar
from plumbline.catalog.sqltext import RAW, SPLIT, frac

Q, SQL, query = registrar()

PLAN = V.ViewPlan(codec_double_p=0.15, jitter_kernels=("area_linear", "cubic_linear"), effects_p=0.35,
                  effects=(("motion_blur", 2.0), ("film_grain", 1.0), ("halftone", 1.0)), ladder_levels=(0.25, 0.0, 0.25, 0.5),
                  robust_skip_webp_p=0.3, view_arms=(0.7, 0.2, 0.1))
SCHEDULE = ({}, {"codec_jpeg_p": 0.2, "effects_p": 0.0, "view_b": "deploy", "view_arms": (0.4, 0.4, 0.2)})


def u(name):
    return frac("concat(image_id,'|',CAST(epoch AS VARCHAR))", f"34|{name}")


def by(a, b):
    return f"CASE WHEN profile=0 THEN {a} ELSE {b} END"


def iv(name, lo, hi):
    return f"CAST(floor({u(name)}*{hi - lo + 1})+{lo} AS INT)"


D = "CAST({} AS DOUBLE)".format
VIEW = f"""pl AS (SELECT image_id, kind, file_index, epoch, epoch%2 profile FROM raw, (SELECT unnest(range(3)) epoch)),
 a AS (SELECT *, CASE WHEN {u('codec')}<{D(0.3)} THEN 'none' WHEN {u('codec')}<{by(D(0.75), D(0.5))} THEN 'jpeg' WHEN {u('codec')}<{by(D(0.9), D(0.65))} THEN 'double' ELSE 'webp' END codec_arm,
  {D(0.6)}+{u('factor')}*{D(0.4)} f, {u('jitter')}<{D(0.4)} j, {u('effect_gate')}<{by(D(0.35), D(0))} fx,
  CASE WHEN {u('view')}<{by(D(0.7), D(0.4))} THEN 'deploy' WHEN {u('view')}<{by(D(0.9), D(0.8))} THEN 'ladder' ELSE 'robust' END view_a FROM pl)
 SELECT image_id, CAST(epoch AS INT) epoch, CAST(profile AS INT) profile, (34*1000003+epoch*9176+file_index)%2147483647 row_seed, codec_arm,
  CASE WHEN codec_arm IN ('jpeg','double') THEN {iv('quality', 55, 98)} WHEN codec_arm='webp' THEN {iv('quality', 60, 95)} END codec_quality,
  CASE WHEN codec_arm='double' THEN {iv('quality2', 55, 98)} END second_quality, CASE WHEN codec_arm='double' THEN {iv('shift_x', 1, 7)} END shift_x, CASE WHEN codec_arm='double' THEN {iv('shift_y', 1, 7)} END shift_y,
  CASE WHEN j AND f<0.999 THEN round(f,6) END jitter_factor, CASE WHEN j AND f<0.999 THEN CASE WHEN {u('kernel')}<0.5 THEN 'area_linear' ELSE 'cubic_linear' END END jitter_kernel,
  CASE WHEN fx THEN CASE WHEN {u('effect')}<0.5 THEN 'motion_blur' WHEN {u('effect')}<0.75 THEN 'film_grain' ELSE 'halftone' END END effect,
  CASE WHEN fx THEN round({D(0.25)}+{u('strength')}*{D(0.75)},6) END effect_strength, CASE WHEN fx THEN round({u('aux')},6) END effect_aux,
  {u('hflip')}<0.5 hflip, {u('vflip')}<0.5 vflip, view_a, {by("'robust'", "'deploy'")} view_b,
  CASE WHEN view_a='ladder' THEN CAST(CASE WHEN {u('level')}<0.25 THEN 0 WHEN {u('level')}<0.5 THEN 2 ELSE 3 END AS INT) END ladder_level,
  CASE WHEN view_a='ladder' THEN CASE WHEN kind='semisynthetic' THEN {D(0)} ELSE {D(0.5)} END END crop_p, view_a='robust' AND {u('skip_webp')}<{D(0.3)} skip_webp FROM a"""


@query("view_plan", "WITH " + RAW + ", " + VIEW)
def _(spark, sf):
    p = V.view_plan(B.raw_manifest(spark, sf), PLAN, SCHEDULE, 3, B.SEED)
    for c in ("jitter_factor", "effect_strength", "effect_aux"):
        p = p.withColumn(c, F.round(c, 6))
    return p


@query("view_arm_shares", "WITH " + RAW + ", v AS (WITH " + VIEW + ") SELECT profile, codec_arm, count(*) n FROM v GROUP BY 1,2")
def _(spark, sf):
    p = V.view_plan(B.raw_manifest(spark, sf), PLAN, SCHEDULE, 3, B.SEED)
    return p.groupBy("profile", "codec_arm").agg(F.count(F.lit(1)).alias("n"))


def pick(key, tag, n):
    return f"CAST(floor({frac(key, '34|' + tag)}*{n}) AS BIGINT)"


EK = "concat(dataset,'|',CAST(job AS VARCHAR))"


@query("edit_plan", "WITH " + SPLIT + f""", x AS (SELECT * FROM s WHERE split='train'), n AS (SELECT dataset, count(*) n FROM x GROUP BY 1), j AS (SELECT dataset, job, job%n row_no FROM n, (SELECT unnest(range(30)) job)),
 nr AS (SELECT image_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY {frac('image_id', '34|order')}, image_id)-1 row_no FROM x)
 SELECT dataset, CAST(job AS INT) job, concat('img_',lpad(CAST(job AS VARCHAR),CAST(greatest(length(CAST(job AS VARCHAR)),6) AS INT),'0'),'.jpg') fname, image_id, CASE job%2 WHEN 0 THEN 'first' ELSE 'second' END editor, {frac(EK, '34|face')}<0.5 want_face,
 CAST({pick(EK, 'quality', 9)}+88 AS INT) quality, {pick(EK, 'seed', 2147483648)} job_seed, concat(dataset,'#blk',CAST(job//64 AS VARCHAR)) source_file FROM j JOIN nr USING (dataset, row_no)""")
def _(spark, sf):
    return J.edit_plan(B.split_manifest(spark, sf, folded=False), 30, ["first", "second"], B.SEED)


@query("swap_plan", "WITH " + RAW + f""", n AS (SELECT dataset, count(*) n, row_number() OVER (ORDER BY dataset)-1 a FROM raw GROUP BY 1), t AS (SELECT count(*) t FROM n),
 nr AS (SELECT image_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY {frac('image_id', '34|order')}, image_id)-1 row_no FROM raw),
 j AS (SELECT job, {pick('job', 'dst', 't')} d, {pick('job', 'src', '(t-1)')} st, t FROM (SELECT unnest(range((SELECT count(*)//2 FROM raw))) job), t),
 k AS (SELECT job, s.dataset src_dataset, e.dataset dst_dataset, {pick('job', 'srcrow', 's.n')} sn, {pick('job', 'dstrow', 'e.n')} en FROM j JOIN n s ON s.a=(d+1+st)%t JOIN n e ON e.a=d)
 SELECT job, concat('img_',lpad(CAST(job AS VARCHAR),CAST(greatest(length(CAST(job AS VARCHAR)),6) AS INT),'0'),'.jpg') fname, src_dataset, p.image_id src_id, dst_dataset, q.image_id dst_id, CAST({pick('job', 'quality', 9)}+88 AS INT) quality, concat(dst_dataset,'#blk',CAST(job//64 AS VARCHAR)) source_file
 FROM k JOIN nr p ON p.dataset=src_dataset AND p.row_no=sn JOIN nr q ON q.dataset=dst_dataset AND q.row_no=en""")
def _(spark, sf):
    m = B.raw_manifest(spark, sf)
    return J.swap_plan(m, m.count() // 2, B.SEED)


@query("prompt_plan", f"""WITH sb AS (SELECT DISTINCT p_type category, concat('a {{adj}} ',p_name) template FROM part), c AS (SELECT category, count(*) n, row_number() OVER (ORDER BY category)-1 a FROM sb GROUP BY 1), t AS (SELECT count(*) t FROM c),
 nb AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY template)-1 no FROM sb), j AS (SELECT job, c.category, {pick('job', 'template', 'n')} no FROM (SELECT unnest(range((SELECT count(*) FROM part))) job), t, c WHERE c.a=job%t)
 SELECT job, j.category, concat(replace(template,'{{adj}}',['old','bright','plain'][{pick('job', 'adj', 3)}+1]),', ',['by day','by night'][{pick('job', 'style', 2)}+1]) prompt, job//64 AS block FROM j JOIN nb ON j.category=nb.category AND j.no=nb.no""")
def _(spark, sf):
    p = B.table(spark, sf, "part")
    subjects = p.select(F.col("p_type").alias("category"), F.concat(F.lit("a {adj} "), F.col("p_name")).alias("template")).distinct()
    return J.prompt_plan(subjects, ["old", "bright", "plain"], ["by day", "by night"], p.count(), B.SEED)
