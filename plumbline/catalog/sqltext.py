"""The bound views as DuckDB SQL. Each is a list of CTE bodies; ``with_views`` puts them in front."""

SEED = 34


def frac(expr: str, seed=SEED) -> str:
    """Same value as functions.scalar.stable_fraction."""
    return (f"(CAST(('0x'||substr(md5(concat(CAST({expr} AS VARCHAR),'|{seed}')),1,13)) AS BIGINT)"
            f"/CAST(4503599627370496 AS DOUBLE))")


def sigmoid(x: str) -> str:
    return f"(1.0/(1.0+exp(-greatest(least({x},CAST(60 AS DOUBLE)),CAST(-60 AS DOUBLE)))))"


RAW = """raw AS (
 SELECT doc_id, concat('doc/', CAST(doc_id AS VARCHAR)) image_id, concat(source,'-',lang) dataset,
  CASE WHEN lang='en' THEN 0 ELSE 1 END label,
  CASE lang WHEN 'en' THEN 'real' WHEN 'de' THEN 'semisynthetic' ELSE 'synthetic' END kind,
  CASE WHEN lang='es' THEN 'niche' WHEN CAST(substring(source,4) AS INT)%5=0 THEN 'diverse'
       ELSE concat('c',CAST(CAST(substring(source,4) AS INT)%5 AS VARCHAR)) END content_category,
  concat('repo/',source) source_path, concat(source,'-',lang) grp,
  concat(source,'#',CAST(CAST(floor(doc_id/20) AS BIGINT)%10 AS VARCHAR)) source_file,
  doc_id file_index, CASE WHEN n_chars%3=0 THEN 'png' ELSE 'jpg' END ext,
  CASE WHEN n_chars%3=0 THEN 'PNG' ELSE 'JPEG' END file_format,
  CASE WHEN n_chars%7=0 THEN 'L' ELSE 'RGB' END pil_mode,
  CASE WHEN lang='en' THEN 'real' ELSE concat('gen-',CAST(CAST(substring(source,4) AS INT)%4 AS VARCHAR)) END generator_family,
  64+n_chars%1500 width, 64+(n_chars*7)%1100 height, n_chars*3 file_bytes,
  least(64+n_chars%1500, 64+(n_chars*7)%1100) min_side, greatest(64+n_chars%1500, 64+(n_chars*7)%1100) max_side
 FROM documents)"""

MANIFEST = RAW + """, fold AS (SELECT content_category cc, count(DISTINCT label) k FROM raw GROUP BY 1),
m AS (SELECT raw.*, max_side/CAST(min_side AS DOUBLE) aspect, width*height/CAST(1000000 AS DOUBLE) megapixels,
  file_bytes/CAST(width*height AS DOUBLE) bytes_per_pixel, CAST(512 AS DOUBLE)/min_side m_eval,
  CASE WHEN k<2 THEN 'diverse' ELSE content_category END category
 FROM raw JOIN fold ON content_category=cc)"""

SPLIT = MANIFEST + f""", s AS (SELECT m.*, source_path split_unit,
  CASE WHEN {frac('source_path')}<0.15 THEN 'val_xgen' WHEN {frac('source_path')}<0.3 THEN 'val_stress'
       WHEN {frac('source_path')}<0.45 THEN 'test' WHEN {frac('source_file')}<0.2 THEN 'val_id' ELSE 'train' END split
 FROM m)"""


def scored(view: str = "deploy", name: str = "sc") -> str:
    f = 1 if view == "deploy" else 4
    d = ", ".join(f"4*CAST(embedding[{f + i}] AS DOUBLE)+(label-CAST(4.5 AS DOUBLE))/5 d{i + 1}" for i in range(3))
    return f"""{name} AS (SELECT vec_id, concat('emb-',CAST(label AS VARCHAR),'-',CAST(vec_id%3 AS VARCHAR)) dataset,
  CASE WHEN label>=5 THEN 1 ELSE 0 END y,
  CASE WHEN label<5 THEN 0 WHEN label<8 THEN 1 ELSE 2 END y3, {d},
  4*CAST(embedding[7] AS DOUBLE)+(label-CAST(7.5 AS DOUBLE))/2 t FROM embeddings)"""


FUSION = (0.5, 0.3, 0.2)


def fused(view: str = "deploy", name: str = "sc") -> str:
    """scored() plus fused margin d, spread and clipped probability."""
    a, b, c = FUSION
    raw = scored(view, name + "_raw")
    return raw + f""", {name} AS (SELECT *, sqrt((d1-d)*(d1-d)*{a}+(d2-d)*(d2-d)*{b}+(d3-d)*(d3-d)*{c}) spread
 FROM (SELECT *, d1*CAST({a} AS DOUBLE)+d2*CAST({b} AS DOUBLE)+d3*CAST({c} AS DOUBLE) d FROM {name}_raw))"""


def _noise(i: int) -> str:
    return (f"((label-CAST(0.5 AS DOUBLE))*2.0+({frac('image_id', f'branch{i}')}-0.5)*4.0"
            f"+CASE WHEN file_format='PNG' THEN CAST(0.3 AS DOUBLE) ELSE CAST(-0.1 AS DOUBLE) END)")


SCORED_MANIFEST = SPLIT + f""", sm AS (SELECT s.*, {_noise(0)} d1, {_noise(1)} d2, {_noise(2)} d3 FROM s),
sf AS (SELECT sm.*, d1*CAST(0.5 AS DOUBLE)+d2*CAST(0.3 AS DOUBLE)+d3*CAST(0.2 AS DOUBLE) d FROM sm)"""


def tallies(where: str = "TRUE", name: str = "psa") -> str:
    return f"""{name} AS (SELECT CASE CAST(user_id%3 AS INT) WHEN 0 THEN 'real' WHEN 1 THEN 'synthetic' ELSE 'semisynthetic' END truth,
  concat('set-',CASE CAST(user_id%7 AS INT) WHEN 0 THEN 'image-holdout-' WHEN 1 THEN 'stream-' ELSE '' END,CAST(user_id%21 AS VARCHAR)) dataset,
  CASE WHEN event_type IN ('view','click') THEN 'real' WHEN event_type='purchase' THEN 'semisynthetic' ELSE 'synthetic' END pred_label,
  count(*) n FROM events WHERE {where} GROUP BY 1,2,3)"""


def with_views(views: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}\n{body}"


def quantile(col: str, p: float, where: str | None = None) -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return f"quantile_cont(CAST({col} AS DOUBLE),{p}){f}"
