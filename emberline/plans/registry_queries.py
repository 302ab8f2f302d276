"""Registered queries over registries, snapshots and the read side, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import staging
from emberline.functions import geo, ids, text
from emberline.operators import dedupe, matching, snapshots
from emberline.plans import serving, thermal_queries, views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(*used: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = views.with_views(sql, *used) if used else sql
        return f

    return add


_S = ["site_id", "name", "industry_type", "state", "district", "evidence_level"]


@query("sites", sql=f"SELECT {', '.join(_S)} FROM sites WHERE is_active AND lower(industry_type) = 'building' AND lat BETWEEN 9 AND 25 AND lon BETWEEN 70 AND 90 ORDER BY site_id LIMIT 50 OFFSET 10")
def site_list(spark, sf_dir):
    f = serving.SiteFilters(equal={"industry_type": "Building"}, bbox=(9, 70, 25, 90))
    return serving.page(serving.sites(views.sites(spark, sf_dir), f), ["site_id"], 50, 10).select(*_S)


@query("sites", sql="SELECT site_id FROM sites WHERE is_active AND (name ILIKE '%uildIN%' OR industry_type ILIKE '%uildIN%' OR state ILIKE '%uildIN%' OR district ILIKE '%uildIN%' OR evidence_level ILIKE '%uildIN%')")
def site_search(spark, sf_dir):
    return serving.sites(views.sites(spark, sf_dir), serving.SiteFilters(search="UILdin")).select("site_id")


@query("sites", sql=" UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM sites WHERE is_active GROUP BY 2" for d in ("state", "district", "industry_type", "evidence_level")))
def site_statistics(spark, sf_dir):
    return serving.statistics(serving.sites(views.sites(spark, sf_dir)), ["state", "district", "industry_type", "evidence_level"])


@query("sites", sql="SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive, count(DISTINCT state) AS states, count(DISTINCT district) AS districts, count(*) FILTER (evidence_level = 'high') AS high_evidence FROM sites")
def dataset_summary(spark, sf_dir):
    return serving.totals(views.sites(spark, sf_dir))


@query("sites", sql="SELECT DISTINCT district, state FROM sites WHERE is_active")
def filter_options(spark, sf_dir):
    return serving.filter_options(views.sites(spark, sf_dir))


@query("sites", sql="SELECT site_id, name FROM sites WHERE site_id < 100 AND name LIKE 'Customer%' ORDER BY site_id DESC LIMIT 20")
def keyset_page(spark, sf_dir):
    return serving.keyset_page(views.sites(spark, sf_dir), "site_id", 100, 20, ("name", "Customer")).select("site_id", "name")


@query("sites", sql="SELECT state, count(*) AS n, count(*) FILTER (evidence_level = 'high') AS n_high FROM sites GROUP BY 1 ORDER BY n DESC, state LIMIT 10")
def dashboard_states(spark, sf_dir):
    return serving.top_states(views.sites(spark, sf_dir), 10)


@query("detections", sql="SELECT acq::date AS day, count(*) AS n FROM detections WHERE acq::date > (SELECT max(acq::date) FROM detections) - 7 GROUP BY 1")
def daily_alerts(spark, sf_dir):
    return serving.daily_counts(views.detections(spark, sf_dir), "acq", 7)


@query("facilities", sql="SELECT ref, kind, sources FROM facilities WHERE list_contains(string_split(sources, ','), 'gem') AND kind IN ('cement', 'gas_flare', 'steel_metal', 'brick_kiln', 'factory_generic') ORDER BY len(string_split(sources, ',')) DESC, ref LIMIT 100")
def facility_source_filter(spark, sf_dir):
    return serving.facilities(views.facilities(spark, sf_dir), ["cement", "gas_flare", "steel_metal", "brick_kiln", "factory_generic"], "gem", limit=100).select("ref", "kind", "sources")


@query("facilities", sql="SELECT ref, name FROM facilities WHERE contains(lower(concat(name, ' ', replace(kind, '_', ' '))), 'supplier') AND contains(lower(concat(name, ' ', replace(kind, '_', ' '))), 'kiln') ORDER BY CASE WHEN starts_with(lower(name), 'supplier kiln') THEN 0 ELSE 1 END, length(name), ref LIMIT 8")
def facility_search(spark, sf_dir):
    return serving.search_facilities(views.facilities(spark, sf_dir), "Supplier kiln").select("ref", "name")


_CL = thermal_queries._CLASSED


@query("detections", "facilities", sql=f"+{_CL} SELECT cluster, thermal_class FROM classed WHERE frp_max >= 10 AND last_seen >= (SELECT max(last_seen) FROM classed) - INTERVAL 48 HOURS AND thermal_class IN ('other', 'unmapped_persistent', 'agricultural_burning')")
def thermal_list(spark, sf_dir):
    f = serving.ThermalFilters(classes=("other", "unmapped_persistent", "agricultural_burning"), min_frp=10, hours=48)
    return serving.thermal(thermal_queries.classified(spark, sf_dir), f).select("cluster", "thermal_class")


@query("detections", "facilities", sql=f"+{_CL} SELECT thermal_class, count(*) AS n, round(sum(frp_total), 1) AS frp_total, sum(n_detections)::bigint AS n_detections FROM classed GROUP BY 1")
def thermal_stats(spark, sf_dir):
    return serving.thermal_stats(thermal_queries.classified(spark, sf_dir))


@query("detections", "facilities", sql=f"+{_CL}, c AS (SELECT floor(lat / 5e-1) * 5e-1 AS cell_lat, floor(lon / 5e-1) * 5e-1 AS cell_lon, thermal_class, count(*) AS n, max(frp_max) AS m FROM classed GROUP BY ALL), t AS (SELECT cell_lat, cell_lon, sum(n)::bigint AS n, max(m) AS frp_max, (arg_min(thermal_class, concat(printf('%06d', 999999 - n), thermal_class))) AS dominant FROM c GROUP BY ALL) SELECT *, round(sqrt(n / (SELECT max(n) FROM t)), 6) AS opacity FROM t")
def density_grid(spark, sf_dir):
    return serving.density(thermal_queries.classified(spark, sf_dir), 0.5).select("cell_lat", "cell_lon", "n", "frp_max", "dominant", F.round("opacity", 6).alias("opacity"))


@query("detections", "facilities", sql=f"+{_CL} SELECT thermal_class, count(*) AS n, round(count(*) / (SELECT count(*) FROM classed), 9) AS share FROM classed GROUP BY 1")
def class_shares(spark, sf_dir):
    return serving.class_shares(thermal_queries.classified(spark, sf_dir)).select("thermal_class", "n", F.round("share", 9).alias("share"))


# ---- registries
@query("left_records", "right_records", sql="SELECT l.id AS left_id, r.id AS right_id FROM left_records l JOIN right_records r ON lower(trim(l.district)) = lower(trim(r.district))")
def block_district(spark, sf_dir):
    return matching.block_district(views.records(spark, sf_dir, 0), views.records(spark, sf_dir, 1))


@query("left_records", "right_records", sql="SELECT l.id AS left_id, r.id AS right_id FROM left_records l JOIN right_records r ON abs(floor(l.lon / 5e-1) - floor(r.lon / 5e-1)) <= 1 AND abs(floor(l.lat / 5e-1) - floor(r.lat / 5e-1)) <= 1")
def block_grid(spark, sf_dir):
    return matching.block_grid(views.records(spark, sf_dir, 0), views.records(spark, sf_dir, 1))


@query("left_records", "right_records", sql="SELECT l.id AS left_id, r.id AS right_id FROM left_records l JOIN right_records r ON left(l.name, 3) = left(r.name, 3) AND left(l.name, 3) <> ''")
def block_prefix(spark, sf_dir):
    return matching.block_prefix(views.records(spark, sf_dir, 0), views.records(spark, sf_dir, 1), 3)


_LR = "left_records l JOIN right_records r ON "
_BLOCKS = f"""blocks AS (SELECT DISTINCT 'd' AS s, l.id AS left_id, r.id AS right_id FROM {_LR} lower(l.district) = lower(r.district) UNION ALL
  SELECT DISTINCT 'g', l.id, r.id FROM {_LR} abs(floor(l.lon / 5e-1) - floor(r.lon / 5e-1)) <= 1 AND abs(floor(l.lat / 5e-1) - floor(r.lat / 5e-1)) <= 1 UNION ALL SELECT DISTINCT 'i', l.id, r.id FROM {_LR} lower(l.industry) = lower(r.industry))"""


def _blocks(spark, sf_dir, cap):
    left, right = views.records(spark, sf_dir, 0), views.records(spark, sf_dir, 1)
    return [matching.block_district(left, right, cap), matching.block_grid(left, right, cap=cap), matching.block_industry(left, right, cap)]


@query("left_records", "right_records", sql=f"+{_BLOCKS}, p AS (SELECT left_id, right_id, count(*) AS strategies FROM blocks GROUP BY ALL) SELECT left_id, right_id, strategies FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY right_id) AS rn FROM p) x WHERE rn <= 50")
def block_union(spark, sf_dir):
    return matching.combined(_blocks(spark, sf_dir, 50))


@query("left_records", "right_records", sql=f"+{_BLOCKS} SELECT left_id, right_id, count(*) AS strategies FROM blocks GROUP BY ALL HAVING count(*) >= 2")
def block_intersection(spark, sf_dir):
    return matching.agreeing(views.records(spark, sf_dir, 0), views.records(spark, sf_dir, 1))


@query(sql="SELECT p_brand, p_partkey AS first_part FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS rn FROM part) x WHERE rn = 1")
def dedupe_identity(spark, sf_dir):
    kept, _ = dedupe.keep_first(staging.table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey")
    return kept.select("p_brand", F.col("p_partkey").alias("first_part"))


@query(sql="""WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 40 END AS sid, (s_suppkey % 20) / 1e1 AS lat, (s_suppkey % 10) / 1e1 AS lon FROM supplier),
  k AS (SELECT s_suppkey, CASE WHEN sid IS NOT NULL THEN concat('id', s_nationkey, '|', sid) ELSE concat('at', lat, '|', lon) END AS k FROM s) SELECT min(s_suppkey) AS s_suppkey FROM k GROUP BY k""")
def dedupe_two_pass(spark, sf_dir):
    s = staging.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    s = s.select("s_suppkey", F.col("s_nationkey").cast("string").alias("src"), F.when(k % 3 != 0, k % 40).alias("sid"), ((k % 20) / 10).alias("lat"), ((k % 10) / 10).alias("lon"))
    return dedupe.two_pass(s, "src", "sid", "s_suppkey").select("s_suppkey")


# ---- snapshots
_CUT = "o_orderkey, o_orderstatus, o_totalprice, o_orderdate"
_OLD = f"old AS (SELECT {_CUT} FROM orders WHERE o_orderkey % 7 <> 0)"
_NEW = f"new AS (SELECT o_orderkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 11 <> 0)"
_HASH = "md5(concat(o_orderstatus, '|', printf('%.2f', o_totalprice)))"


def _cuts(spark, sf_dir):
    o = staging.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    return o.filter(k % 7 != 0), o.filter(k % 11 != 0).withColumn("o_totalprice", F.col("o_totalprice") + F.when(k % 5 == 0, 1).otherwise(0))


@query(sql=f"WITH {_OLD}, {_NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN n.o_totalprice > o.o_totalprice THEN 'updated' ELSE 'unchanged' END AS change FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey")
def snapshot_diff(spark, sf_dir):
    old, new = _cuts(spark, sf_dir)
    return snapshots.difference(old, new, ["o_orderkey"], stamp="o_totalprice")


@query(sql=f"WITH {_OLD}, {_NEW}, u AS (SELECT *, 0 AS ord FROM old UNION ALL SELECT *, 1 FROM new) SELECT o_orderkey, arg_max(o_orderstatus, ord) AS o_orderstatus, arg_max(o_totalprice, ord) AS o_totalprice, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM u GROUP BY 1")
def temporal_merge(spark, sf_dir):
    old, new = (d.select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen")) for d in _cuts(spark, sf_dir))
    return snapshots.temporal_merge(old, new, ["o_orderkey"])


def _staged(spark, sf_dir):
    h = F.md5(F.concat(F.col("o_orderstatus"), F.lit("|"), F.format_string("%.2f", F.col("o_totalprice"))))
    old, new = (d.withColumn("content_hash", h) for d in _cuts(spark, sf_dir))
    return new, old.withColumn("is_active", F.col("o_orderkey") % 13 != 0)


@query(sql=f"WITH {_OLD}, {_NEW}, m AS (SELECT o_orderkey, {_HASH} AS h, o_orderkey % 13 <> 0 AS is_active FROM old), s AS (SELECT o_orderkey, {_HASH} AS h FROM new) SELECT coalesce(m.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN m.h IS NULL THEN 'insert' WHEN s.h IS NULL THEN CASE WHEN is_active THEN 'deactivate' ELSE 'keep' END WHEN NOT is_active OR m.h <> s.h THEN 'update' ELSE 'keep' END AS action FROM m FULL JOIN s ON m.o_orderkey = s.o_orderkey")
def change_detection(spark, sf_dir):
    return snapshots.changes(*_staged(spark, sf_dir), "o_orderkey")


@query(sql=f"WITH {_OLD}, {_NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, n.o_orderkey IS NOT NULL AS is_active FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey")
def soft_delete(spark, sf_dir):
    stage, master = _staged(spark, sf_dir)
    out, _ = snapshots.synchronise(stage, master, "o_orderkey")
    return out.select("o_orderkey", F.when(F.col("is_active"), F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "is_active")


@query(sql="WITH l AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS audit_id FROM supplier) SELECT audit_id FROM l WHERE audit_id % 10 = 0")
def hash_chain_verify(spark, sf_dir):
    """A chain over the suppliers in which the name of every tenth row was altered after the fact."""
    rows = staging.table(spark, sf_dir, "supplier").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("rows"))
    start = F.array().cast("array<struct<s_name:string,prev_hash:string,row_hash:string>>")

    def link(done, r):
        prev = F.try_element_at(done, F.lit(-1))["row_hash"]
        own = F.sha2(F.concat_ws("|", F.coalesce(prev, F.lit("")), r["s_name"]), 256)
        return F.concat(done, F.array(F.struct(r["s_name"].alias("s_name"), prev.alias("prev_hash"), own.alias("row_hash"))))

    log = rows.select(F.posexplode(F.aggregate("rows", start, link)).alias("i", "r")).select((F.col("i") + 1).cast("long").alias("audit_id"), "r.*")
    altered = staging.persisted(log.withColumn("s_name", F.when(F.col("audit_id") % 10 == 0, F.lit("altered")).otherwise(F.col("s_name"))), "audit")
    return snapshots.broken_links(altered, "audit_id", ["s_name"]).select("audit_id")


@query("facilities", sql="+c AS (SELECT ref // 3 AS grp, string_split(sources, ',')[1] AS source, sum(capacity_mw) AS c FROM facilities GROUP BY ALL) SELECT grp, round(max(c), 4) AS capacity_mw, count(*) AS source_count FROM c GROUP BY 1")
def facility_capacity(spark, sf_dir):
    """Sum within a source, largest over sources."""
    f = views.facilities(spark, sf_dir).groupBy(F.expr("ref DIV 3").alias("grp"), F.split("sources", ",")[0].alias("source")).agg(F.sum("capacity_mw").alias("c"))
    return f.groupBy("grp").agg(F.round(F.max("c"), 4).alias("capacity_mw"), F.count("*").alias("source_count"))


@query(sql="SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[\\-_/\\\\]+', ' ', 'g'), '\\s+', ' ', 'g')) AS normalised FROM part")
def name_normalise(spark, sf_dir):
    """The driver's part names hold no abbreviations; those are held by tests."""
    return staging.table(spark, sf_dir, "part").select("p_partkey", text.normalise_name(F.col("p_name"), fold=False).alias("normalised"))


@query(sql="WITH m(alias, code) AS (VALUES ('standard', 'A'), ('promo', 'B'), ('economy', 'C'), ('small', 'D')) SELECT p_partkey, coalesce(code, 'OTHER') AS code FROM part LEFT JOIN m ON alias = lower(split_part(p_type, ' ', 1))")
def taxonomy_map(spark, sf_dir):
    from emberline.operators import quality

    aliases = spark.createDataFrame([("Standard", "A"), ("promo", "B"), ("ECONOMY", "C"), ("small", "D"), ("promo ", "X")], "alias string, code string")
    p = staging.table(spark, sf_dir, "part").withColumn("value", F.split_part("p_type", F.lit(" "), F.lit(1)))
    return quality.classified(p, "value", aliases, "OTHER").select("p_partkey", "code")


@query(sql="SELECT s_suppkey, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', (('0x' || substr(h, 17, 1))::int % 4) + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS facility_id FROM (SELECT s_suppkey, sha1(unhex('5a1d3c9e4d8f4a559d6e7b7c0f3a2c11') || encode(s_name)) AS h FROM supplier) x")
def facility_uuid(spark, sf_dir):
    return staging.table(spark, sf_dir, "supplier").select("s_suppkey", ids.uuid5(ids.FACILITY_NAMESPACE, F.col("s_name")).alias("facility_id"))


@query("facilities", sql="SELECT ref, round(sqrt(pow(6378137e0 * (radians(lon) - radians(80e0)), 2) + pow(6378137e0 * (ln(tan(pi() / 4 + radians(lat) / 2)) - ln(tan(pi() / 4 + radians(20e0) / 2))), 2)), 2) AS d FROM facilities")
def mercator_distance(spark, sf_dir):
    return views.facilities(spark, sf_dir).select("ref", F.round(geo.mercator_distance_m("lat", "lon", 20.0, 80.0), 2).alias("d"))
