"""Queries over split units, carves, the full assignment and its checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.functions import scalar as S
from plumbline.operators import splits as P
from plumbline.operators import units as U
from plumbline.catalog.base import registrar, rows
from plumbline.catalog.sqltext import MANIFEST, SPLIT, frac

Q, SQL, query = registrar()

CLIQUES = "q1|src1-en;q1|src2-de;q1|nowhere;q2|src7-fr;q2|src9-es;q3|src9-en;q3|src11-en"
UNITS = MANIFEST + """, ds AS (SELECT DISTINCT dataset, source_path FROM m),
 clq(cid,name) AS (VALUES ('q1','src1-en'),('q1','src2-de'),('q2','src7-fr'),('q2','src9-es'),('q3','src9-en'),('q3','src11-en')),
 e AS (SELECT a.dataset u, b.dataset v FROM ds a JOIN ds b ON a.source_path=b.source_path
       UNION SELECT a.name, b.name FROM clq a JOIN clq b ON a.cid=b.cid),
 reach AS (SELECT dataset a, dataset b FROM ds UNION SELECT r.a, e.v FROM reach r JOIN e ON r.b=e.u),
 unit AS (SELECT a dataset, min(b) split_unit FROM reach GROUP BY 1)"""


def cliques(spark):
    return rows(spark, CLIQUES, "clique_id string, name string")


def held(spark, sf):
    """Every dataset of two sources is held out."""
    d = B.raw_manifest(spark, sf).select(F.col("dataset").alias("name"), "source_path").distinct()
    split = F.when(F.col("source_path") == "repo/src3", "val_xgen").when(F.col("source_path") == "repo/src5", "test").when(
        F.col("source_path") == "repo/src6", "val_stress")
    return d.select(split.alias("split"), "name").filter("split is not null")


HELD = """, hold AS (SELECT CASE source_path WHEN 'repo/src3' THEN 'val_xgen' WHEN 'repo/src5' THEN 'test' ELSE 'val_stress' END split, dataset name
 FROM ds WHERE source_path IN ('repo/src3','repo/src5','repo/src6'))"""


@query("stable_fractions", f"SELECT doc_id, round({frac('doc_id')},9) u FROM documents")
def _(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id")
    return d.select("doc_id", F.round(S.stable_fraction(F.col("doc_id"), 34), 9).alias("u"))


@query("split_units", "WITH RECURSIVE " + UNITS + " SELECT dataset, split_unit FROM unit")
def _(spark, sf):
    return U.split_units(B.raw_manifest(spark, sf), cliques(spark))


@query("unit_designation", "WITH RECURSIVE " + UNITS + HELD + """ SELECT split_unit, min(split) split, count(DISTINCT split) n_splits
 FROM (SELECT * FROM hold UNION ALL SELECT 'test', 'src11-fr' UNION ALL SELECT 'val_xgen', 'src7-en') h JOIN unit ON dataset=name GROUP BY 1""")
def _(spark, sf):
    units = U.split_units(B.raw_manifest(spark, sf), cliques(spark))
    more = rows(spark, "test|src11-fr;val_xgen|src7-en;test|nowhere", "split string, name string")
    return U.designate(units, held(spark, sf).unionByName(more))


@query("absent_holdouts", "WITH " + MANIFEST + " SELECT DISTINCT 'test' split, concat(dataset,'-gone') name FROM m WHERE label=1")
def _(spark, sf):
    m = B.raw_manifest(spark, sf)
    units = m.select("dataset", F.col("source_path").alias("split_unit")).distinct()
    h = m.filter("label = 1").select(F.lit("test").alias("split"), F.concat("dataset", F.lit("-gone")).alias("name")).distinct()
    return U.absent_holdouts(units, h.unionByName(units.select(F.lit("test").alias("split"), F.col("dataset").alias("name"))))


@query("unit_sizes", "WITH " + SPLIT + " SELECT split_unit, count(*) datasets, max(n) largest, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT split_unit, dataset, count(*) n FROM s GROUP BY 1,2) GROUP BY 1")
def _(spark, sf):
    return U.unit_sizes(B.split_manifest(spark, sf, folded=False))


@query("mixed_units", "WITH " + SPLIT + " SELECT split_unit, count(*) FILTER (WHERE label=0) real_rows, count(*) FILTER (WHERE label=1) fake_rows FROM s GROUP BY 1 HAVING count(DISTINCT label)=2")
def _(spark, sf):
    return U.mixed_units(B.split_manifest(spark, sf, folded=False))


def _blocks(size: str) -> str:
    """Block of each row of s given st(files, n, neg)."""
    return f"""CASE WHEN files>=8 THEN source_file ELSE CAST(greatest(CASE WHEN neg>0.5*n THEN pos ELSE file_index END,0)//greatest(8,{size}//16) AS VARCHAR) END"""


STATS = """, st AS (SELECT dataset, count(DISTINCT source_file) files, count(*) n, count(*) FILTER (WHERE file_index<0) neg FROM x GROUP BY 1),
 y AS (SELECT x.*, files, n, neg, row_number() OVER (PARTITION BY x.dataset ORDER BY image_id)-1 pos FROM x JOIN st ON x.dataset=st.dataset)"""


@query("block_keys", "WITH " + MANIFEST + ", x AS (SELECT * REPLACE (CASE WHEN dataset LIKE '%-fr' THEN -1 ELSE file_index END AS file_index, CASE WHEN lang_en THEN source_file ELSE 'one' END AS source_file) FROM (SELECT *, label=0 lang_en FROM m))" + STATS
       + f" SELECT image_id, {_blocks('n')} block FROM y")
def _(spark, sf):
    m = B.raw_manifest(spark, sf)
    m = m.withColumn("file_index", F.when(F.col("dataset").endswith("-fr"), -1).otherwise(F.col("file_index")))
    m = m.withColumn("source_file", F.when(F.col("label") == 0, F.col("source_file")).otherwise("one"))
    return P.block_keys(m).select("image_id", "block")


CARVE_KEYS = STATS + f""", us AS (SELECT split_unit, count(*) datasets, max(n) largest FROM (SELECT split_unit, dataset, count(*) n FROM x GROUP BY 1,2) GROUP BY 1),
 k AS (SELECT y.*, CASE WHEN datasets=1 THEN concat(dataset,'|',{_blocks('n')}) ELSE concat(y.split_unit,'|',{_blocks('largest')}) END carve_key
       FROM y JOIN us ON y.split_unit=us.split_unit)"""


def _pick(src, name, share, salt="", unit="split_unit", key="carve_key"):
    u = frac(f"concat({key},'{salt}')")
    return f""", {name}_c AS (SELECT {unit}, {key}, count(*) c FROM {src} GROUP BY 1,2),
 {name}_r AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY {unit} ORDER BY {u}, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) b,
   sum(c) OVER (PARTITION BY {unit}) t, count(*) OVER (PARTITION BY {unit}) kk FROM {name}_c),
 {name} AS (SELECT {unit}, {key} FROM {name}_r WHERE kk>=2 AND b<greatest(1,round_even(t*CAST({share} AS DOUBLE),0)))"""


@query("carve_keys", "WITH " + SPLIT + ", x AS (SELECT * FROM s WHERE split IN ('train','val_id'))" + CARVE_KEYS + " SELECT image_id, carve_key FROM k")
def _(spark, sf):
    return P.carve_keys(B.split_manifest(spark, sf, folded=False).filter("split in ('train', 'val_id')")).select("image_id", "carve_key")


CARVED = CARVE_KEYS + _pick("k", "vi", 0.2) + ", kv AS (SELECT k.* FROM k SEMI JOIN vi ON k.split_unit=vi.split_unit AND k.carve_key=vi.carve_key)" + _pick("kv", "vc", 0.4, "|val_cal") + """,
 cv AS (SELECT k.*, CASE WHEN vc.carve_key IS NOT NULL THEN 'val_cal' WHEN vi.carve_key IS NOT NULL THEN 'val_id' ELSE 'train' END new_split
  FROM k LEFT JOIN vi ON k.split_unit=vi.split_unit AND k.carve_key=vi.carve_key LEFT JOIN vc ON k.split_unit=vc.split_unit AND k.carve_key=vc.carve_key)"""


@query("val_carve", "WITH " + SPLIT + ", x AS (SELECT * FROM s)" + CARVED + " SELECT image_id, new_split split FROM cv")
def _(spark, sf):
    m = B.split_manifest(spark, sf, folded=False).drop("split")
    return P.carve(m, 0.2, 0.4, B.SEED).select("image_id", "split")


@query("dataset_carve", "WITH " + SPLIT + ", x AS (SELECT * FROM s)" + STATS + f", k AS (SELECT image_id, dataset, concat(dataset,'|',{_blocks('n')}) ck FROM y)"
       + _pick("k", "vi", 0.2, unit="dataset", key="ck") + " SELECT image_id, CASE WHEN vi.ck IS NULL THEN 'train' ELSE 'val_id' END split FROM k LEFT JOIN vi ON k.ck=vi.ck")
def _(spark, sf):
    return P.carve_by_dataset(B.split_manifest(spark, sf, folded=False), 0.2, B.SEED).select("image_id", "split")


@query("train_cap", "WITH " + SPLIT + f""", r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {frac('image_id')}, image_id) rk FROM s WHERE split='train' AND NOT contains(dataset,'src1'))
 SELECT s.image_id, CASE WHEN r.rk>5 THEN 'unused' ELSE s.split END split FROM s LEFT JOIN r ON s.image_id=r.image_id""")
def _(spark, sf):
    return P.cap_train(B.split_manifest(spark, sf, folded=False), 5, B.SEED, exempt=["src1"]).select("image_id", "split")


@query("split_assignment", "WITH RECURSIVE " + UNITS + HELD + """, des AS (SELECT DISTINCT split_unit, split FROM hold JOIN unit ON dataset=name),
 base AS (SELECT m.*, unit.split_unit, coalesce(des.split,'train') split FROM m JOIN unit ON m.dataset=unit.dataset LEFT JOIN des ON unit.split_unit=des.split_unit),
 x AS (SELECT * FROM base WHERE split='train')""" + CARVED + f""", cp AS (SELECT image_id, row_number() OVER (PARTITION BY dataset ORDER BY {frac('image_id')}, image_id) rk FROM cv WHERE new_split='train')
 SELECT cv.image_id, split_unit, CASE WHEN rk>9 THEN 'unused' ELSE new_split END split FROM cv LEFT JOIN cp ON cv.image_id=cp.image_id
 UNION ALL SELECT image_id, split_unit, split FROM base WHERE split<>'train'""")
def _(spark, sf):
    out = P.assign(B.raw_manifest(spark, sf), cliques(spark), held(spark, sf), seed=B.SEED, val_id_frac=0.2,
                   val_cal_frac=0.4, per_dataset_cap=9)
    return out.select("image_id", "split_unit", "split")


_GATED = "(SELECT split, name FROM hold UNION SELECT DISTINCT 'val_stress', dataset FROM m WHERE source_path='repo/src2')"


@query("gated_assignment", "WITH RECURSIVE " + UNITS + HELD + f""", des AS (SELECT DISTINCT split_unit, split FROM {_GATED} h JOIN unit ON dataset=name),
 base AS (SELECT m.*, unit.split_unit, coalesce(des.split,'train') split FROM m JOIN unit ON m.dataset=unit.dataset LEFT JOIN des ON unit.split_unit=des.split_unit),
 x AS (SELECT * FROM base WHERE split='train')""" + CARVED + """ SELECT image_id, split_unit, new_split split FROM cv UNION ALL SELECT image_id, split_unit, split FROM base WHERE split<>'train'""")
def _(spark, sf):
    """The split with one source behind a closed gate and another behind an open one."""
    m = B.raw_manifest(spark, sf)
    named = m.filter(F.col("source_path").isin("repo/src2", "repo/src3")).select("source_path", "label", "dataset").distinct()
    gates = named.select(F.col("source_path").alias("gate"), (F.col("source_path") == "repo/src3").alias("include"), F.lit("val_stress").alias("dest"),
                         F.when(F.col("label") == 0, "real").otherwise("fake").alias("side"), F.col("dataset").alias("name"))
    out = P.assign(m, cliques(spark), held(spark, sf), seed=B.SEED, val_id_frac=0.2, val_cal_frac=0.4, gates=gates)
    return out.select("image_id", "split_unit", "split")


@query("split_summary", "WITH " + SPLIT + """ SELECT split, category, count(*) n, count(DISTINCT dataset) datasets, round(avg(label),6) p_fake,
 count(*) FILTER (WHERE label=0) real_rows, count(DISTINCT label) labels FROM s GROUP BY GROUPING SETS ((split),(split,category))""")
def _(spark, sf):
    return P.summary(B.split_manifest(spark, sf)).withColumn("p_fake", F.round("p_fake", 6))


@query("held_out_members", "WITH " + SPLIT + " SELECT DISTINCT 'family' AS what, generator_family AS name FROM s WHERE split='val_xgen' AND label=1 UNION ALL SELECT DISTINCT 'real_dataset', dataset FROM s WHERE split='val_xgen' AND label=0")
def _(spark, sf):
    return P.held_out_members(B.split_manifest(spark, sf))


BAD = "CASE WHEN doc_id%97=0 THEN 'test' WHEN category='c3' AND label=0 AND split='train' THEN 'unused' WHEN split='val_xgen' AND label=1 THEN 'unused' ELSE split END"
STRADDLE = """SELECT split_unit, count(DISTINCT family) families, count(DISTINCT dataset) datasets FROM (SELECT split_unit, dataset,
 CASE WHEN split IN ('train','val_id','val_cal','unused') THEN 'train' ELSE split END family FROM z) GROUP BY 1 HAVING count(DISTINCT family)>1"""


def broken(spark, sf):
    """The split table with planted faults."""
    return B.split_manifest(spark, sf).withColumn("split", F.expr(BAD))


@query("straddle_check", "WITH " + SPLIT + f", z AS (SELECT * REPLACE ({BAD} AS split) FROM s) " + STRADDLE)
def _(spark, sf):
    return P.straddling_units(broken(spark, sf))


RULES = f""", z AS (SELECT * REPLACE ({BAD} AS split) FROM s), st AS ({STRADDLE}),
 t AS (SELECT nm, count(split) n, count(DISTINCT label) k, avg(label) p, max(CASE WHEN kind='semisynthetic' THEN 1 ELSE 0 END) has_semi
   FROM (SELECT unnest(['train','val_id','val_xgen','val_cal','test']) nm) LEFT JOIN z ON split=nm GROUP BY 1),
 rules AS (SELECT CASE WHEN nm IN ('train','val_id') THEN 'error' ELSE 'warn' END severity, 'empty' code, nm subject FROM t WHERE n=0 AND nm<>'val_cal'
  UNION ALL SELECT 'error','one_label',nm FROM t WHERE n>0 AND k<2
  UNION ALL SELECT 'warn','no_semisynthetic',nm FROM t WHERE nm='val_cal' AND n>0 AND k=2 AND has_semi=0
  UNION ALL SELECT 'warn','prior',nm FROM t WHERE nm IN ('val_xgen','test') AND n>0 AND (p<0.35 OR p>0.65)
  UNION ALL SELECT CASE split WHEN 'train' THEN 'error' ELSE 'warn' END,'one_label_category',concat(split,'/',category) FROM z WHERE split IN ('train','val_xgen','test') GROUP BY split, category HAVING count(DISTINCT label)=1
  UNION ALL SELECT 'error','straddles',split_unit FROM st)"""


@query("split_rules", "WITH " + SPLIT + RULES + " SELECT * FROM rules")
def _(spark, sf):
    return P.split_rules(broken(spark, sf))


@query("gate_verdict", "WITH " + SPLIT + RULES + " SELECT count(*) FILTER (WHERE severity='error') hard, count(*) FILTER (WHERE severity='warn') warn, count(*) FILTER (WHERE severity='error')=0 passed FROM rules")
def _(spark, sf):
    return P.gate_verdict(P.split_rules(broken(spark, sf)))
