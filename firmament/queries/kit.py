"""Adapter views over the test tables, query registration and SQL text helpers.

The same view text runs in Spark and in DuckDB; a check query is a WITH prefix of the
views it needs plus its own SELECT.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# name -> (tables or views it reads, SELECT text valid in both engines)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        if n in VIEWS:
            for d in _needed(VIEWS[n][0]):
                if d not in out:
                    out.append(d)
            if n not in out:
                out.append(n)
    return out


def mentioned(sql: str) -> tuple[str, ...]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))
    return tuple(n for n in VIEWS if n in words)


def with_views(sql: str) -> str:
    """Prefix a SELECT with the CTEs it mentions."""
    ctes = [f"{n} AS (\n{VIEWS[n][1]}\n)" for n in _needed(mentioned(sql))]
    if not ctes:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + sql.lstrip()[len("WITH RECURSIVE"):]
    if sql.lstrip().upper().startswith("WITH"):
        return "WITH " + ",\n".join(ctes) + ",\n" + sql.lstrip()[len("WITH"):]
    return "WITH " + ",\n".join(ctes) + "\n" + sql


def define_view(name: str, sql: str) -> None:
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))
    deps = tuple(n for n in VIEWS if n in words)
    VIEWS[name] = (deps, sql)


def sql_df(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    text = with_views(sql)
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text))
    for t in TABLES:
        if t in words:
            table(spark, sf, t).createOrReplaceTempView(t)
    return spark.sql(text)


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf, name)
    return sql_df(spark, sf, f"SELECT * FROM {name}")


def query(key: str, sql: str | None = None):
    """Register a query; `sql` is its DuckDB equivalent (views are prefixed)."""
    def wrap(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn
    return wrap


def r6(c) -> F.Column:
    """Doubles leave a query rounded to 6 places, without a negative zero.

    Spark's round writes and reads a decimal text. Away from a tie, and below 1e5 where the millionths are safe from rounding, the nearest whole
    number of millionths is the same result.
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    y = x * 1e6
    plain = (F.abs(x) < 1e5) & (F.abs(F.abs(y - F.floor(y)) - 0.5) > 1e-4)
    return F.when(plain, F.rint(y) / 1e6).otherwise(F.round(x, 6)) + F.lit(0.0)


def s6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column and widen every integer one."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in ("double", "float"):
            out.append(r6(f.name).alias(f.name))
        elif t in ("int", "smallint", "tinyint"):
            out.append(F.col(f.name).cast("long").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# --- DuckDB expression texts -------------------------------------------------------------

def sep_sql(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    return (
        f"degrees(acos(least(1.0, greatest(-1.0, sin(radians({dec1})) * sin(radians({dec2})) + "
        f"cos(radians({dec1})) * cos(radians({dec2})) * cos(radians({ra1} - {ra2}))))))"
    )


def flat_sql(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    dra = f"(((({ra1} - {ra2}) + 180.0) % 360.0 + 360.0) % 360.0 - 180.0)"
    return f"(sqrt(power({dec1} - {dec2}, 2) + power({dra} * cos(radians({dec1})), 2)) * 60.0)"


def half_up_sql(x: str) -> str:
    return f"floor({x} + 0.5)"


def values_sql(rows) -> str:
    """VALUES rows of a literal dimension."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, int):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def case_sql(col: str, mapping: dict) -> str:
    esc = lambda v: "'" + str(v).replace("'", "''") + "'"
    return f"CASE {col} " + " ".join(f"WHEN {esc(k)} THEN {esc(v)}" for k, v in mapping.items()) + " END"


def in_sql(items) -> str:
    return "(" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + ")"


# --- adapter views ------------------------------------------------------------------------

define_view("v_catalog", """
SELECT o_orderkey AS obj_id,
       (o_orderkey * CAST(137.50776405 AS DOUBLE)) % 360 AS ra_deg,
       degrees(asin(((o_orderkey * 7919) % 20011) / CAST(10005.5 AS DOUBLE) - 1)) AS dec_deg,
       CASE o_orderkey % 13 WHEN 0 THEN 'HII' WHEN 1 THEN 'RNe' WHEN 2 THEN 'DNe' WHEN 3 THEN 'GlC' WHEN 4 THEN 'OpC'
            WHEN 5 THEN 'G' WHEN 6 THEN 's*r' WHEN 7 THEN 'WR*' WHEN 8 THEN 'PN' WHEN 9 THEN 'SNR' WHEN 10 THEN 'Rad'
            WHEN 11 THEN 'MoC' ELSE 'zz' END AS otype,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST((o_orderkey * 31) % 300 AS DOUBLE) / 4 END AS size_major,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST((o_orderkey * 17) % 1200 AS DOUBLE) / 100 END AS mag,
       CASE WHEN o_orderkey % 97 = 0 THEN concat('M ', CAST(o_orderkey AS VARCHAR(20))) END AS messier,
       CASE WHEN o_orderkey % 4 = 0 THEN concat('NGC ', CAST(o_orderkey AS VARCHAR(20))) END AS ngc,
       CASE WHEN o_orderkey % 11 = 0 THEN concat('Sh 2-', CAST(o_orderkey AS VARCHAR(20))) END AS sharpless,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'SIMBAD' ELSE 'OpenNGC' END AS source
FROM orders""")

define_view("v_cat", """
SELECT *, coalesce(messier, ngc, sharpless, CASE WHEN obj_id % 2 = 0 THEN concat('TGU H', CAST(obj_id AS VARCHAR(20)))
                                     ELSE concat('Obj ', CAST(obj_id AS VARCHAR(20))) END) AS main_id,
       CASE WHEN source = 'SIMBAD' THEN 0 ELSE 2 END AS src_rank, obj_id AS row_idx
FROM v_catalog""")

define_view("v_frames", """
SELECT c_custkey AS fid,
       (c_custkey * CAST(222.49223595 AS DOUBLE)) % 360 AS ra0,
       degrees(asin(((c_custkey * 104729) % 2003) / CAST(1001.5 AS DOUBLE) - 1)) AS dec0,
       CAST(2000 AS DOUBLE) AS crpix_x, CAST(1500 AS DOUBLE) AS crpix_y, CAST(2.33 AS DOUBLE) / 3600 AS scale_deg,
       CAST((c_custkey * 37) % 360 AS DOUBLE) AS orientation_deg,
       CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END AS parity, 4000 AS width, 3000 AS height
FROM customer""")

define_view("v_annotations", """
SELECT p_partkey AS anno_id, p_partkey % 40 AS entry_ord,
       concat('NGC', CAST((p_partkey % 40) * 4 AS VARCHAR(20))) AS primary_id,
       CASE p_size % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'in_review' ELSE 'approved' END AS status,
       CASE p_size % 4 WHEN 0 THEN 'pillar' WHEN 1 THEN 'shell' WHEN 2 THEN 'filament' ELSE 'jet' END AS feature_type,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS label_en
FROM part""")

define_view("v_edit_log", """
SELECT user_id AS report, event_id AS seq, ts,
       CASE event_type WHEN 'click' THEN 'setCircle' WHEN 'view' THEN 'nudge' WHEN 'purchase' THEN 'setColor'
            WHEN 'signup' THEN 'addFeature' ELSE 'deleteFeature' END AS action,
       concat('f', CAST(event_id % 5 AS VARCHAR(20))) AS feature_id, value
FROM events""")

define_view("v_saves", """
SELECT user_id % 20 AS entry_key, event_id AS seq, ts, CAST(floor(value) AS BIGINT) % 4 AS rev FROM events""")

define_view("v_solves", """
SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'failed' ELSE 'solved' END AS status,
       CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 2 END AS version,
       CASE WHEN lang = 'en' THEN 'remote' ELSE 'local' END AS solver, CAST(n_chars AS DOUBLE) AS solve_ms
FROM documents""")

define_view("v_outputs", """
SELECT conv_id, turn, concat('Sure: ```json', chr(10), '{"id":"c', CAST(conv_id AS VARCHAR(20)), '","n":',
       CAST(turn AS VARCHAR(20)), CASE WHEN turn % 2 = 0 THEN ',}' ELSE '}' END, chr(10), '```') AS raw
FROM conversations""")


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The adapter catalogue in candidate shape."""
    c = view(spark, sf, "v_cat")
    ids = F.map_filter(
        F.create_map(F.lit("messier"), F.col("messier"), F.lit("ngc"), F.col("ngc"), F.lit("sharpless"), F.col("sharpless")),
        lambda _, v: v.isNotNull(),
    )
    return (
        c.withColumn("catalog_ids", ids).withColumn("names", F.array("main_id"))
        .withColumn("size_minor", F.col("size_major"))
        .withColumn("common_name", F.lit(None).cast("struct<zh:string,en:string>"))
        .withColumn("famous", F.lit(False))
        .drop("messier", "ngc", "sharpless")
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_frames")


# --- check-side building blocks: cone, projection, gate, scores ------------------------------

from firmament.dims import vocab as V  # noqa: E402

CATEGORY_SQL = (
    f"coalesce({case_sql('trim(otype)', V.OTYPE_CATEGORY)}, CASE WHEN contains(trim(otype), '*') THEN 'star' END)"
)

define_view("q_cone", f"""
SELECT f.*, c.*, {sep_sql('f.ra0', 'f.dec0', 'c.ra_deg', 'c.dec_deg')} AS sep_deg
FROM v_frames f, v_cat c
WHERE {sep_sql('f.ra0', 'f.dec0', 'c.ra_deg', 'c.dec_deg')} <= sqrt(power(f.width, 2) + power(f.height, 2)) / 2 * f.scale_deg""")

define_view("q_plane", """
SELECT *, sin(radians(dec0)) * sin(radians(dec_deg)) + cos(radians(dec0)) * cos(radians(dec_deg)) * cos(radians(ra_deg - ra0)) AS cosc
FROM q_cone""")

define_view("q_std", """
SELECT *, cos(radians(dec_deg)) * sin(radians(ra_deg - ra0)) / cosc / radians(scale_deg) AS xi,
       (cos(radians(dec0)) * sin(radians(dec_deg)) - sin(radians(dec0)) * cos(radians(dec_deg)) * cos(radians(ra_deg - ra0)))
         / cosc / radians(scale_deg) AS eta
FROM q_plane WHERE cosc > 0""")

define_view("q_px", """
SELECT * FROM (SELECT *, crpix_x + parity * (cos(radians(orientation_deg)) * xi + sin(radians(orientation_deg)) * eta) AS px,
       crpix_y - (cos(radians(orientation_deg)) * eta - sin(radians(orientation_deg)) * xi) AS py FROM q_std)
WHERE px >= -0.05 * greatest(width, height) AND px <= width + 0.05 * greatest(width, height)
  AND py >= -0.05 * greatest(width, height) AND py <= height + 0.05 * greatest(width, height)""")

define_view("q_gated", f"""
SELECT * FROM (
 SELECT *, {CATEGORY_SQL} AS category, size_major / 2 / (scale_deg * 60) AS rpx FROM q_px
 WHERE trim(otype) NOT IN {in_sql(V.NON_OPTICAL)})
WHERE category IS NOT NULL AND (size_major IS NULL OR rpx <= 1
  OR greatest(0, least(px + rpx, width) - greatest(px - rpx, 0)) * greatest(0, least(py + rpx, height) - greatest(py - rpx, 0)) / (4 * rpx * rpx) >= 0.5
  OR (abs(px - width / 2) <= rpx AND abs(py - height / 2) <= rpx))""")

NICK_SQL = f"upper(main_id) IN {in_sql([k.upper() for k in V.NICKNAMES])}"
NICK_ANY = " OR ".join(f"coalesce(upper({c}) IN {in_sql([k.upper() for k in V.NICKNAMES])}, FALSE)" for c in ("messier", "ngc", "sharpless", "main_id"))

define_view("q_scored", f"""
SELECT *, ({NICK_ANY}) AS curated,
  ((CASE WHEN messier IS NOT NULL THEN 1000.0 WHEN ngc IS NOT NULL THEN 500.0 WHEN sharpless IS NOT NULL THEN 300.0 ELSE 0.0 END)
   + coalesce(least(size_major, 300), 0) + CASE WHEN ({NICK_ANY}) THEN 500.0 ELSE 0.0 END
   + coalesce(greatest(0, 6.5 - mag) * 60, 0))
  * (1 - 0.4 * greatest(0, (greatest(abs(px - width / 2.0) / (width / 2.0), abs(py - height / 2.0) / (height / 2.0)) - 0.5) / 0.5)) AS score,
  CASE WHEN category = 'star' THEN 'star' WHEN category IN ('globular_cluster', 'open_cluster') THEN 'cluster'
       WHEN category = 'galaxy' THEN 'galaxy' ELSE 'nebula' END AS kind
FROM q_gated""")

define_view("q_prominent", f"""
SELECT * FROM q_scored WHERE CASE kind WHEN 'star' THEN coalesce(mag < 4, FALSE)
  WHEN 'cluster' THEN messier IS NOT NULL OR ngc IS NOT NULL
  WHEN 'galaxy' THEN (messier IS NOT NULL OR ngc IS NOT NULL) AND coalesce(size_major, 0) >= 3
  ELSE (messier IS NOT NULL OR ngc IS NOT NULL OR sharpless IS NOT NULL OR curated OR NOT regexp_matches(main_id, '{V.SURVEY_NAME}'))
       AND coalesce(size_major, 0) >= 8 END""")

define_view("q_topkind", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fid, kind ORDER BY CASE WHEN kind = 'star' THEN coalesce(mag, 99) ELSE -score END, src_rank, row_idx) AS kind_rank
FROM q_prominent) WHERE kind_rank <= CASE kind WHEN 'galaxy' THEN 1 ELSE 2 END""")

define_view("q_kept", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY score DESC, g, k) AS rnk FROM (
  SELECT *, row_number() OVER (PARTITION BY fid, obj_id ORDER BY g) AS once FROM (
    SELECT *, CASE kind WHEN 'star' THEN 0 WHEN 'cluster' THEN 1 WHEN 'nebula' THEN 2 ELSE 3 END AS g, kind_rank AS k FROM q_topkind
    UNION ALL BY NAME
    SELECT * EXCLUDE (tr), 9 AS g, 1 AS k, 1 AS kind_rank FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY score DESC, src_rank, row_idx) AS tr FROM q_scored) WHERE tr = 1))
  WHERE once = 1) WHERE rnk <= 6""")

define_view("q_chosen", """
SELECT * FROM q_kept UNION ALL BY NAME
SELECT s.*, 100 + row_number() OVER (PARTITION BY s.fid ORDER BY s.src_rank, s.row_idx) AS rnk
FROM q_scored s ANTI JOIN q_kept k ON s.fid = k.fid AND s.obj_id = k.obj_id WHERE s.curated""")

BUBBLE_SQL = f"upper(replace(main_id, ' ', '')) IN {in_sql(V.WIND_BUBBLES)}"

define_view("q_bubble", f"""
SELECT * EXCLUDE (bn, bsep) FROM (
 SELECT s.*, {sep_sql('n.ra_deg', 'n.dec_deg', 's.ra_deg', 's.dec_deg')} AS bsep,
   row_number() OVER (PARTITION BY n.fid, n.obj_id ORDER BY {sep_sql('n.ra_deg', 'n.dec_deg', 's.ra_deg', 's.dec_deg')}, s.src_rank, s.row_idx) AS bn
 FROM (SELECT * FROM q_chosen WHERE category = 'emission_nebula' AND size_major IS NOT NULL AND {BUBBLE_SQL}) n
 JOIN (SELECT s.* FROM q_scored s ANTI JOIN q_chosen k ON s.fid = k.fid AND s.obj_id = k.obj_id WHERE otype IN ('WR*', 'WR?')) s
   ON s.fid = n.fid AND {sep_sql('n.ra_deg', 'n.dec_deg', 's.ra_deg', 's.dec_deg')} < n.size_major / 120)
WHERE bn = 1""")

define_view("q_selected", """
SELECT *, row_number() OVER (PARTITION BY fid ORDER BY rnk) AS rank FROM (
  SELECT * FROM q_chosen UNION ALL BY NAME
  SELECT *, 100000 + row_number() OVER (PARTITION BY fid ORDER BY src_rank, row_idx) AS rnk FROM q_bubble)""")


# --- Spark-side counterparts -----------------------------------------------------------------

def gated(spark: SparkSession, sf: str, pick=None) -> DataFrame:
    """Gated candidates; with `pick`, those that it does not rule out, with what a selection reads of them."""
    from firmament.operators import select as S
    from firmament.operators import spatial

    # Nicknames, category, significance and prominence are the catalogue row's own: they are found before it meets any frame.
    rows = S.appraise(S.nickname_overlay(catalog(spark, sf)))
    c = spatial.in_frame_join(frames(spark, sf), rows if pick is None else rows.select(*[c for c in SELECTION if c in rows.columns]), pick=pick)
    return S.gate_candidates(c, appraised=True)


#: What a selection reads or shows of a candidate; all else would be sorted with every pair.
SELECTION = ("fid", "obj_id", "main_id", "names", "otype", "category", "curated", "ra_deg", "dec_deg", "size_major", "mag", "px", "py", "width", "height",
             "weight", "noted", "src_rank", "row_idx")


def selected(spark: SparkSession, sf: str) -> DataFrame:
    from firmament.operators import select as S

    return S.select_objects(gated(spark, sf, S.Selectable()).select(*SELECTION), few=True)
