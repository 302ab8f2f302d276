"""The engine's inputs derived from the driver's tables, with DuckDB twins of each view.

Only integer and simple float arithmetic is used, so both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import staging

KIND_LIST = ["brick_kiln", "cement", "chemical_fertilizer", "factory_generic", "gas_flare", "landfill", "mining_quarry", "power_thermal", "refinery_petrochem", "steel_metal"]
_INSTRUMENTS = ["VIIRS_SNPP_SP", "VIIRS_SNPP_NRT", "VIIRS_NOAA20_SP", "VIIRS_NOAA21_NRT"]


def _pick(number: str, names: list[str]) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


_DET = f"""SELECT event_id AS detection_id, ts AS acq, value AS frp,
  8 + (user_id * 37 % 2400) / 1e2 + (event_id * 13 % 7) * 2e-3 AS lat,
  69 + (user_id * 53 % 2700) / 1e2 + (event_id * 29 % 11) * 9.5e-3 AS lon,
  {_pick('event_id % 4', _INSTRUMENTS)} AS instrument,
  CASE event_type WHEN 'error' THEN 'low' WHEN 'signup' THEN 'high' ELSE 'nominal' END AS confidence,
  CASE WHEN extract(hour FROM ts) < 6 OR extract(hour FROM ts) >= 18 THEN 'N' ELSE 'D' END AS daynight, event_type, user_id
FROM events"""
_FAC = f"""SELECT s_suppkey AS ref, s_name AS name, 8 + (s_suppkey * 37 % 2400) / 1e2 AS lat, 69 + (s_suppkey * 53 % 2700) / 1e2 AS lon,
  {_pick('s_suppkey % 10', KIND_LIST)} AS kind, cast(400 + (s_suppkey % 5) * 300 AS double) AS radius_m, s_acctbal AS capacity_mw,
  CASE s_suppkey % 5 WHEN 0 THEN 'osm' WHEN 1 THEN 'osm,gem' WHEN 2 THEN 'wri_gppd' WHEN 3 THEN 'osm,wri_gppd,gem' ELSE 'vnf' END AS sources
FROM supplier"""
_SITES = """SELECT c_custkey AS site_id, c_name AS name, c_mktsegment AS industry_type, n_name AS state, r_name AS district, c_acctbal AS balance,
  CASE WHEN c_acctbal >= 6000 THEN 'high' WHEN c_acctbal >= 2000 THEN 'medium' ELSE 'low' END AS evidence_level, c_custkey % 11 <> 0 AS is_active,
  8 + (c_custkey * 37 % 2400) / 1e2 AS lat, 69 + (c_custkey * 53 % 2700) / 1e2 AS lon
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_AREAS = """SELECT n_nationkey AS area_id, n_name AS area_name, 69 + (n_nationkey // 5) * 5.6e0 AS xmin, 8 + (n_nationkey % 5) * 5e0 AS ymin,
  69 + (n_nationkey // 5) * 5.6e0 + 5.6e0 AS xmax, 8 + (n_nationkey % 5) * 5e0 + 5e0 AS ymax FROM nation"""
_RECORD = """SELECT p_partkey AS id, p_name AS name, p_type AS industry, p_brand AS district, p_size AS size,
  8 + (p_partkey * 7 % 1200) / 1e2 AS lat, 69 + (p_partkey * 11 % 1300) / 1e2 AS lon FROM part WHERE p_partkey % 2 = {side}"""

#: Records close enough to compare: a few within some hundred metres of each.
_NEAR = """SELECT p_partkey AS id, p_name AS name, p_type AS industry, p_brand AS district, 20 + (p_partkey * 7 % 97) / 1e3 AS lat, 75 + (p_partkey * 11 % 89) / 1e3 AS lon
FROM part WHERE p_partkey % 2 = {side}"""
#: Facilities in groups of three neighbours of one kind, some of them side by side.
_DENSE = f"""SELECT s_suppkey AS ref, s_name AS name, 20 + (s_suppkey // 3 * 7 % 13) * 3e-3 + (s_suppkey % 3) * 1e-3 AS lat, 75 + (s_suppkey // 3 * 11 % 17) * 3e-3 AS lon,
  {_pick('s_suppkey // 3 % 10', KIND_LIST)} AS kind, cast(400 + (s_suppkey % 5) * 300 AS double) AS radius_m, s_acctbal AS capacity_mw,
  CASE s_suppkey % 5 WHEN 0 THEN 'osm' WHEN 1 THEN 'gem' WHEN 2 THEN 'wri_gppd' WHEN 3 THEN 'ggfr' ELSE 'vnf' END AS source
FROM supplier"""

#: DuckDB text of each view.
SQL = {"near_left": _NEAR.format(side=0), "near_right": _NEAR.format(side=1), "dense_facilities": _DENSE, "detections": _DET, "facilities": _FAC, "sites": _SITES, "admin_areas": _AREAS, "left_records": _RECORD.format(side=0), "right_records": _RECORD.format(side=1)}


def with_views(body: str, *names: str) -> str:
    """A DuckDB statement with the named views as common table expressions before body (which may add more)."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + (", " if body.lstrip().startswith(("+",)) else " ") + body.lstrip().removeprefix("+")


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The same text in Spark, over the tables it names."""
    text = sql.replace("//", " DIV ")
    return spark.sql(_named(text, tables), **{t: staging.table(spark, sf_dir, t) for t in tables})


def _named(text: str, tables: tuple[str, ...]) -> str:
    import re

    for t in tables:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return text


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _DET, "events")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _FAC, "supplier")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _SITES, "customer", "nation", "region")


def admin_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the box as a ring of five points."""
    box = _view(spark, sf_dir, _AREAS, "nation")
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(point("xmin", "ymin"), point("xmax", "ymin"), point("xmax", "ymax"), point("xmin", "ymax"), point("xmin", "ymin"))
    return box.withColumn("rings", F.array(ring))


def records(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    return _view(spark, sf_dir, SQL["left_records" if side == 0 else "right_records"], "part")


def near_records(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    return _view(spark, sf_dir, SQL["near_left" if side == 0 else "near_right"], "part")


def dense_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _DENSE, "supplier")
