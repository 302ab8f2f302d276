"""Registered queries over similarity, greedy merges, whole chains, loaders, sinks and geometry, with their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from emberline import staging
from emberline.functions import geo, ids, text
from emberline.operators import alerts, baseline, dedupe, facilities, heat_sources, learning, matching, spatial
from emberline.plans import analysis, pipelines, serving, thermal_queries, views
from emberline.sources import government, registries, sinks
from emberline.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}
NEAR_M = 600


def query(*used: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = views.with_views(sql, *used) if used else sql
        return f

    return add


# ---- similarity of names
def _similar(pairs: str) -> str:
    """Twin of the token-set similarity: tsim(a, b, score) for the pairs of texts that the statement gives. The longest
    common subsequence goes through the second text a character at a time, over a row of lengths."""
    words = lambda c: f"list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"
    rest = lambda x, y: f"array_to_string(list_sort(list_filter({x}, lambda w: NOT list_contains({y}, w))), ' ')"
    best = "list_transform(range(1, length(f) + 2), lambda i: list_max(list_transform(range(1, i + 1), lambda k: greatest(row[k], CASE WHEN k > 1 AND substr(f, (k - 1)::integer, 1) = substr(g, (j + 1)::integer, 1) THEN row[k - 1] + 1 ELSE 0 END))))"
    return f"""tp AS (SELECT DISTINCT a, b FROM ({pairs}) x), tw AS (SELECT a, b, {words('a')} AS x, {words('b')} AS y FROM tp),
  tj AS (SELECT a, b, len(x) = 0 OR len(y) = 0 AS none, array_to_string(list_sort(list_intersect(x, y)), ' ') AS c, {rest('x', 'y')} AS l, {rest('y', 'x')} AS r FROM tw),
  tf AS (SELECT *, trim(concat(c, ' ', l)) AS f, trim(concat(c, ' ', r)) AS g FROM tj),
  lcs(f, g, j, row) AS (SELECT DISTINCT f, g, 0::bigint, list_transform(range(0, length(f) + 1), lambda i: 0::bigint) FROM tf UNION ALL SELECT f, g, j + 1, {best} FROM lcs WHERE j < length(g)),
  lc AS (SELECT f, g, row[length(f) + 1] AS n FROM lcs WHERE j = length(g)),
  tsim AS (SELECT a, b, CASE WHEN none THEN 0e0 WHEN c <> '' AND (l = '' OR r = '') THEN 1e2 ELSE greatest(2e2 * n / (length(tf.f) + length(tf.g)), CASE WHEN c <> '' THEN greatest(2e2 * length(c) / (length(c) + length(tf.f)), 2e2 * length(c) / (length(c) + length(tf.g))) ELSE 0e0 END) END AS score
    FROM tf JOIN lc ON lc.f = tf.f AND lc.g = tf.g)"""


_CLOSE = f"abs(l.lat - r.lat) < 1e-2 AND abs(l.lon - r.lon) < 1e-2 AND {thermal_queries._hav('l', 'r')} <= {NEAR_M}"
_PAIRS = f"near_left l JOIN near_right r ON {_CLOSE}"
_SCORED = f"""{_similar('SELECT l.name AS a, r.name AS b FROM near_left l CROSS JOIN near_right r UNION SELECT l.industry, r.industry FROM near_left l CROSS JOIN near_right r')},
  p AS (SELECT l.id AS left_id, r.id AS right_id, {thermal_queries._hav('l', 'r')} AS d, n.score / 100 AS ns, i.score / 100 AS isc FROM {_PAIRS} JOIN tsim n ON n.a = l.name AND n.b = r.name JOIN tsim i ON i.a = l.industry AND i.b = r.industry),
  q AS (SELECT *, (greatest(0e0, 1 - least(d / {NEAR_M}e0, 1e0)) * 4e-1 + ns * 3e-1 + isc * 1e-1) / (4e-1 + 3e-1 + 1e-1) AS s FROM p)"""
_UUID = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', (('0x' || substr(h, 17, 1))::int % 4) + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12))"


def _near(spark, sf_dir):
    return views.near_records(spark, sf_dir, 0), views.near_records(spark, sf_dir, 1)


@query("near_left", "near_right", sql=f"SELECT l.id AS left_id, r.id AS right_id FROM {_PAIRS}")
def block_radius(spark, sf_dir):
    return matching.block_radius(*_near(spark, sf_dir), NEAR_M)


def _pair_scores(spark, sf_dir):
    left, right = _near(spark, sf_dir)
    return matching.scored_within(left, right, NEAR_M, matching.Weights(max_distance_m=float(NEAR_M)))


@query("near_left", "near_right", sql=f"+{_SCORED} SELECT left_id, right_id, round(s, 6) AS match_score, CASE WHEN s >= 0.85 THEN 'automatic_match' WHEN s >= 0.65 THEN 'uncertain_review' ELSE 'non_match' END AS match_confidence FROM q")
def pair_scores(spark, sf_dir):
    return _pair_scores(spark, sf_dir).select("left_id", "right_id", text.rounded("match_score", 6).alias("match_score"), "match_confidence")


@query("near_left", "near_right", sql=f"""+{_SCORED}, h AS (SELECT *, sha1(unhex('{matching.URL_NAMESPACE.replace('-', '')}') || encode(concat('candidate:', left_id, '|', right_id))) AS h FROM q)
  SELECT {_UUID} AS candidate_id, round(ns, 6) AS name_score, round(isc, 6) AS industry_score, concat(CASE WHEN isc >= 0.8 THEN 'industry+' ELSE '' END, CASE WHEN ns >= 0.8 THEN 'name+' ELSE '' END, 'spatial') AS match_method FROM h""")
def pair_scores_token_set(spark, sf_dir):
    """Part scores, reasons and identifiers of the candidates."""
    return _pair_scores(spark, sf_dir).select("candidate_id", text.rounded("name_score", 6).alias("name_score"), text.rounded("industry_score", 6).alias("industry_score"), "match_method")


@query(sql=f"WITH RECURSIVE {_similar('SELECT a.p_name AS a, b.p_name AS b FROM part a CROSS JOIN part b')}, one AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, round(score, 6) AS token_set FROM one a CROSS JOIN one b JOIN tsim ON tsim.a = a.p_name AND tsim.b = b.p_name WHERE a.p_name < b.p_name")
def text_similarity(spark, sf_dir):
    names = staging.table(spark, sf_dir, "part").select("p_name").distinct()
    pairs = names.select(F.col("p_name").alias("a")).join(names.select(F.col("p_name").alias("b")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(text.token_set_ratio("a", "b"), 6).alias("token_set"))


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring(concat('  ', w, ' '), i, 3)))))"


@query("near_left", sql=f"+t AS (SELECT id, lat, lon, {_TRI.format(c='name')} AS g FROM near_left) SELECT l.id AS a, r.id AS b, round(len(list_intersect(l.g, r.g)) / (len(l.g) + len(r.g) - len(list_intersect(l.g, r.g))), 6) AS similarity FROM t l JOIN t r ON l.id < r.id AND {_CLOSE} WHERE len(list_intersect(l.g, r.g)) / (len(l.g) + len(r.g) - len(list_intersect(l.g, r.g))) >= 0.3")
def trigram_similarity(spark, sf_dir):
    return dedupe.trigram_pairs(views.near_records(spark, sf_dir, 0), "id", NEAR_M, 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


# ---- greedy, in order
def _turns(nodes: str, edges: str) -> str:
    """kept(id): nodes (id) that no kept one before them covers by an edge (a, b), one turn after another."""
    return f"""turns AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM {nodes}), covers AS (SELECT b AS id, list(a) AS before FROM {edges} GROUP BY b),
  walk(k, taken) AS (SELECT 0::bigint, []::bigint[] UNION ALL SELECT t.k, CASE WHEN c.before IS NULL OR len(list_intersect(w.taken, c.before)) = 0 THEN list_append(w.taken, t.id::bigint) ELSE w.taken END FROM walk w JOIN turns t ON t.k = w.k + 1 LEFT JOIN covers c ON c.id = t.id),
  kept AS (SELECT unnest(arg_max(taken, k)) AS id FROM walk)"""


@query("near_left", sql=f"""+{_similar('SELECT l.name AS a, r.name AS b FROM near_left l CROSS JOIN near_left r')}, likes AS (SELECT l.id AS a, r.id AS b, score FROM near_left l JOIN near_left r ON l.id < r.id AND {_CLOSE} JOIN tsim ON tsim.a = l.name AND tsim.b = r.name WHERE score >= 70),
  hard AS (SELECT a, b FROM likes WHERE score >= 90), {_turns('near_left', 'hard')}, gone AS (SELECT b AS id, min(a) AS anchor FROM hard WHERE a IN (SELECT id FROM kept) GROUP BY b),
  soft AS (SELECT a, b FROM likes LEFT JOIN gone ON gone.id = b WHERE score < 90 AND a IN (SELECT id FROM kept) AND (anchor IS NULL OR anchor > a)), flags AS (SELECT a AS id FROM soft UNION SELECT b FROM soft)
  SELECT n.id, gone.anchor AS duplicate_of, n.id IN (SELECT id FROM flags) AS flagged FROM near_left n LEFT JOIN gone ON gone.id = n.id""")
def near_duplicate_records(spark, sf_dir):
    none = F.lit(None).cast("string")
    r = views.near_records(spark, sf_dir, 0).withColumns({"state": F.lit("x"), "industry": none, "district": none})
    return dedupe.near_duplicates(r, "id", reach_m=NEAR_M).select("id", "duplicate_of", "flagged")


_KIND_RADIUS = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {r}e0" for k, (_, r) in heat_sources.KINDS.items()) + " END"
_PRIORITY = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(facilities.SOURCES, 1)) + " END"
_FITS = f"(l.kind = r.kind OR l.kind = '{facilities.GENERIC}' OR r.kind = '{facilities.GENERIC}')"


@query("dense_facilities", sql=f"""+f AS (SELECT *, {_PRIORITY} AS prio, row_number() OVER (ORDER BY CASE WHEN kind = '{facilities.GENERIC}' THEN 1 ELSE 0 END, {_PRIORITY}, source, ref::varchar) AS id FROM dense_facilities),
  e AS (SELECT l.id AS a, r.id AS b FROM f l JOIN f r ON l.id < r.id AND {_FITS} AND {thermal_queries._hav('l', 'r')} <= 500), {_turns('f', 'e')},
  own AS (SELECT f.*, coalesce((SELECT min(a) FROM e WHERE e.b = f.id AND a IN (SELECT id FROM kept)), f.id) AS anchor FROM f),
  d AS (SELECT r.*, l.lat AS a_lat, l.lon AS a_lon, l.kind AS a_kind, l.source AS primary_source, l.ref AS a_ref, round({thermal_queries._hav('l', 'r')}, 1) AS dist FROM own r JOIN f l ON l.id = r.anchor),
  ps AS (SELECT anchor, source, sum(capacity_mw) AS c, min(prio) AS p FROM d GROUP BY ALL), per AS (SELECT anchor, max(c) AS c, count(*) AS n, string_agg(source, ',' ORDER BY p) AS sources FROM ps GROUP BY 1),
  body AS (SELECT anchor, any_value(a_lat) AS lat, any_value(a_lon) AS lon, any_value(primary_source) AS primary_source, any_value(a_ref) AS a_ref, arg_min(name, id) AS name, max(radius_m + dist) AS reach,
    CASE WHEN any_value(a_kind) = '{facilities.GENERIC}' THEN coalesce(arg_min(kind, id) FILTER (kind <> '{facilities.GENERIC}'), any_value(a_kind)) ELSE any_value(a_kind) END AS kind FROM d GROUP BY 1),
  u AS (SELECT body.*, c, n, sources, sha1(unhex('{ids.FACILITY_NAMESPACE.replace('-', '')}') || encode(concat(primary_source, ':', a_ref))) AS h FROM body JOIN per ON per.anchor = body.anchor)
  SELECT {_UUID} AS facility_id, name, kind, round(lat, 6) AS lat, round(lon, 6) AS lon, round(least(greatest(reach, {_KIND_RADIUS.format(c='kind')}), 6e3), 3) AS radius_m, round(c, 4) AS capacity_mw, primary_source, n AS source_count, sources FROM u""")
def facility_merge(spark, sf_dir):
    none = F.lit(None).cast("string")
    r = views.dense_facilities(spark, sf_dir).withColumn("source_id", F.col("ref").cast("string")).withColumns({"status": none, "fuel": none, "footprint": none, "footprint_area": F.lit(0.0)}).drop("ref")
    m = facilities.merge(r)[0]
    return m.select("facility_id", "name", "kind", *[F.round(c, n).alias(c) for c, n in (("lat", 6), ("lon", 6), ("radius_m", 3), ("capacity_mw", 4))], "primary_source", "source_count", "sources")


# ---- evidence and the whole analysis
def _sentence(name: str) -> str:
    """An evidence text as SQL; whole numbers are rounded half up."""
    whole = lambda x: f"floor({x} + 0.5)::bigint"
    values = {
        "kind": "replace(coalesce(site_kind, 'facility'), '_', ' ')", "site": "coalesce(site_name, ref::varchar, 'None')", "n_days": "n_days", "window_days": "14", "extent_m": whole("extent_m"),
        "night_pct": whole("100 * night_fraction"), "frp_max": whole("frp_max"), "crop_pct": whole("100 * ((cluster % 10) / 1e1)"), "veg_pct": whole("100 * ((cluster % 4) / 8e0)"),
    }
    pattern, used = heat_sources.EVIDENCE[name]
    bits, at = [], 0
    for mark in re.finditer(r"%s|%d|%\.0f", pattern):
        bits += [repr(pattern[at : mark.start()].replace("%%", "%")), values[used[len(bits) // 2]]]
        at = mark.end()
    return "concat(" + ", ".join([*bits, repr(pattern[at:].replace("%%", "%"))]).replace('"', "'") + ")"


def _reasons() -> str:
    f = thermal_queries.evidence_sql("((cluster % 10) / 1e1)", "((cluster % 4) / 8e0)", "((cluster % 3) / 1e1)", "cluster % 9 = 0")
    parts = []
    for c in heat_sources.CLASSES:
        for i, (n, w) in enumerate(heat_sources.WEIGHTS[c].items()):
            if w > 0:
                parts.append(f"SELECT cluster, {i} AS i, {w}e0 * {f[n]} AS v, {_sentence(n)} AS t FROM named WHERE thermal_class = '{c}' AND {w}e0 * {f[n]} > 0.25")
    labels = "CASE class " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in heat_sources.LABELS.items()) + " END"
    return f"""named AS (SELECT classed.*, f.name AS site_name FROM classed LEFT JOIN facilities f ON f.ref = classed.ref), lines AS ({' UNION ALL '.join(parts)}),
  runner AS (SELECT cluster, 99 AS i, -1e0 AS v, concat('second most likely: ', lower({labels}), ' (', floor(100 * p + 0.5)::bigint, '% of evidence)') AS t FROM ordered WHERE rn = 2 AND p >= 0.2),
  texts AS (SELECT cluster, string_agg(t, ' | ' ORDER BY v DESC, i) AS reasons FROM (SELECT * FROM lines UNION ALL SELECT * FROM runner) x GROUP BY 1)
  SELECT classed.cluster, {labels.replace('class ', 'thermal_class ', 1)} AS thermal_label, coalesce(reasons, '') AS reasons FROM classed LEFT JOIN texts ON texts.cluster = classed.cluster"""


@query("detections", "facilities", sql=f"+{thermal_queries._CLASSED}, {_reasons()}")
def classify_reasons(spark, sf_dir):
    return thermal_queries.classified(spark, sf_dir).select("cluster", "thermal_label", F.concat_ws(" | ", "reasons").alias("reasons"))


_BARE = thermal_queries._classified_sql("0e0", "0e0", "0e0", "true")


@query("detections", "facilities", "admin_areas", sql=f"""+{_BARE}, {thermal_queries._PROFILE},
  today AS (SELECT scope, key, arg_max(s, day) AS s FROM (SELECT 'facility' AS scope, facility_id::varchar AS key, acq::date AS day, sum(frp) AS s FROM assigned WHERE facility_id IS NOT NULL GROUP BY ALL UNION ALL SELECT 'cell', cell_key, acq::date, sum(frp) FROM assigned GROUP BY ALL) x GROUP BY ALL),
  counted AS (SELECT c.cluster, a.cell_key, count(*) AS n FROM clustered c JOIN assigned a ON a.detection_id = c.detection_id GROUP BY ALL), modal AS (SELECT cluster, cell_key FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, cell_key) AS rn FROM counted) x WHERE rn = 1),
  entity AS (SELECT classed.*, CASE WHEN t.key IS NOT NULL THEN 'facility' ELSE 'cell' END AS scope, coalesce(t.key, modal.cell_key) AS key FROM classed JOIN modal ON modal.cluster = classed.cluster LEFT JOIN today t ON t.scope = 'facility' AND t.key = classed.ref::varchar)
  SELECT e.cluster, e.thermal_class, e.ref IS NOT NULL AS site_within, (SELECT arg_min(area_name, area_id) FROM admin_areas WHERE lon >= xmin AND lon < xmax AND lat >= ymin AND lat < ymax) AS state, e.scope AS baseline_scope,
    round_even((today.s - coalesce(mean, 0)) / greatest(coalesce(std, 0), 1), 2) AS frp_z, p.key IS NOT NULL AS baseline_known,
    CASE WHEN thermal_class = 'industrial_fire_candidate' AND hours <= 24 AND frp_max >= 8 THEN CASE WHEN frp_max >= 100 THEN 'critical' WHEN frp_max >= 40 THEN 'high' ELSE 'watch' END WHEN thermal_class = 'industrial_persistent' AND e.n_days >= 4 AND frp_recent_max >= 3 * greatest(frp_mean, 1) AND frp_recent_max >= 30 THEN 'high' END AS alert_level
  FROM entity e LEFT JOIN today ON today.scope = e.scope AND today.key = e.key LEFT JOIN profile p ON p.scope = e.scope AND p.key = e.key""")
def analyse_pipeline(spark, sf_dir):
    """The whole chain: clusters, facilities, rules, states and baselines. Ids of sources have a query of their own."""
    det, fac = views.detections(spark, sf_dir), views.facilities(spark, sf_dir)
    profile = baseline.compute(thermal_queries.assigned(spark, sf_dir), window_days=thermal_queries.WINDOW, exclude_days=thermal_queries.EXCLUDE)
    s, _ = analysis.analyse(det, fac, views.admin_areas(spark, sf_dir), F.lit(1), profile=profile)
    return s.select("cluster", "thermal_class", "site_within", "state", "baseline_scope", "frp_z", "baseline_known", "alert_level")


@query(sql="SELECT doc_id, CASE WHEN doc_id % 5 IN (1, 3) THEN 'good' ELSE 'bad' END AS model_class, CASE WHEN doc_id % 5 IN (1, 3) THEN CASE WHEN doc_id % 2 = 0 THEN 'agrees' ELSE 'differs' END ELSE CASE WHEN doc_id % 2 = 0 THEN 'differs' ELSE 'agrees' END END AS opinion, true AS sums_to_one FROM documents WHERE doc_id >= 0")
def second_opinion(spark, sf_dir):
    """Trained, calibrated and scored on a class that two of three values of a feature and their neighbours decide; the
    others are noise. The rules' class is the parity of the id."""
    k = F.col("doc_id")
    d = staging.table(spark, sf_dir, "documents").select("doc_id", F.when((k % 5).isin(1, 3), "good").otherwise("bad").alias("label"), F.concat(F.lit("r"), (k % 7).cast("string")).alias("region"), (k % 5).cast("double").alias("part"), F.when(k % 6 != 0, F.length("text") % 13).cast("double").alias("noise"))
    m = learning.train(d, ["part", "noise"], ["good", "bad"], "label", "region", rounds=3)
    s = learning.score(m, d)
    ok = F.abs(F.aggregate(F.map_values("model_scores"), F.lit(0.0), lambda a, b: a + b) - 1) < 1e-9
    return s.select("doc_id", "model_class", serving.model_opinion(F.col("model_class"), F.when(k % 2 == 0, "good").otherwise("bad")).alias("opinion"), ok.alias("sums_to_one"))


# ---- loaders
def _document(df, value: str, head: str):
    """One JSON document with an array of the values."""
    return df.agg(F.concat(F.lit(head), F.array_join(F.collect_list(value), ","), F.lit("]}")).alias("value"))


@query("facilities", sql=f"""SELECT concat('map:', ref) AS source_id, CASE WHEN ref % 3 = 1 THEN 'cement' ELSE kind END AS kind, round(lat, 6) AS lat, round(lon, 6) AS lon,
  round(least(CASE WHEN ref % 3 = 2 THEN greatest(sqrt((4e-2 * 110540) * (4e-2 * 111320 * cos(radians(lat))) / 3.141592653589793), {_KIND_RADIUS.format(c='kind')}) WHEN ref % 3 = 1 THEN 1200e0 ELSE {_KIND_RADIUS.format(c='kind')} END, 6e3), 3) AS radius_m FROM facilities WHERE ref % 7 <> 0""")
def map_point_features(spark, sf_dir):
    """A feature collection: kinds from the property or the tags, radii from bounds or kind, other geometries left out."""
    n = F.col("ref")
    bounds = F.when(n % 3 == 2, F.struct((F.col("lat") - 0.02).alias("minlat"), (F.col("lon") - 0.02).alias("minlon"), (F.col("lat") + 0.02).alias("maxlat"), (F.col("lon") + 0.02).alias("maxlon")))
    properties = F.struct(F.concat(F.lit("map:"), n).alias("source_ref"), "name", F.when(n % 3 != 1, F.col("kind")).alias("kind"), F.when(n % 3 == 1, F.create_map(F.lit("industrial"), F.lit("cement"))).alias("tags"), bounds.alias("bounds"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.when(n % 7 == 0, "LineString").otherwise("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), properties.alias("properties"))
    path = staging.new_path(spark, "features")
    _document(views.facilities(spark, sf_dir).select(F.to_json(feature).alias("v")), "v", '{"type":"FeatureCollection","features":[').write.text(path)
    return registries.map_features(spark, path).select("source_id", "kind", *[F.round(c, k).alias(c) for c, k in (("lat", 6), ("lon", 6), ("radius_m", 3))])


@query(sql="""SELECT n_nationkey AS osm_id, CASE n_nationkey % 6 WHEN 0 THEN 'node' WHEN 1 THEN 'way' WHEN 2 THEN 'way' ELSE 'relation' END AS osm_type, n_name AS name,
  CASE n_nationkey % 6 WHEN 0 THEN 'node' WHEN 1 THEN 'way' WHEN 2 THEN 'way' WHEN 3 THEN 'relation_reconstructed' ELSE 'relation_center_fallback' END AS geometry_source, CASE n_nationkey % 6 WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS n_points,
  CASE n_nationkey % 6 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS n_rings, CASE n_nationkey % 6 WHEN 1 THEN 1e0 WHEN 3 THEN 3e0 ELSE 0e0 END AS area, n_nationkey % 6 IN (0, 1, 3) AS industrial FROM nation WHERE n_nationkey % 6 <> 5""")
def map_elements(spark, sf_dir):
    """Nodes, closed and open ways, relations stitched from ways that run either way and hold a hole, relations with a
    centre only, and such without geometry, which are dropped."""
    k, x = F.col("n_nationkey"), F.col("n_nationkey").cast("double")
    at = lambda *ps: F.array(*[F.struct(F.lit(float(b)).alias("lat"), (x + float(a)).alias("lon")) for a, b in ps])
    square, line = at((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), at((0, 0), (1, 1))
    member = lambda role, ps: F.struct(F.lit("way").alias("type"), F.lit(role).alias("role"), ps.alias("geometry"))
    members = F.array(member("outer", at((0, 0), (2, 0), (2, 2))), member("outer", at((0, 0), (0, 2), (2, 2))), member("inner", at((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5))))
    kind = F.when(k % 6 == 0, "node").when(k % 6 < 3, "way").otherwise("relation")
    tags = F.create_map(F.lit("name"), F.col("n_name"), F.when((k % 6).isin(0, 1, 3), "landuse").otherwise("highway"), F.when((k % 6).isin(0, 1, 3), "industrial").otherwise("road"))
    element = F.struct(
        kind.alias("type"), k.alias("id"), F.when(k % 6 == 0, 1.0).alias("lat"), F.when(k % 6 == 0, x).alias("lon"), tags.alias("tags"), F.when(k % 6 == 1, square).when(k % 6 == 2, line).alias("geometry"),
        F.when(k % 6 == 4, F.struct(F.lit(1.0).alias("lat"), x.alias("lon"))).alias("center"), F.when(k % 6 == 3, members).alias("members"),
    )
    path = staging.new_path(spark, "elements")
    _document(staging.table(spark, sf_dir, "nation").select(F.to_json(element).alias("v")), "v", '{"elements":[').write.text(path)
    e = registries.map_elements(spark, path)
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    outer, hole = F.abs(geo.ring_area(F.col("rings")[0])), F.abs(geo.ring_area(F.get("rings", F.lit(1))))
    area = F.when(F.col("rings").isNotNull(), outer - F.coalesce(hole, F.lit(0.0))).otherwise(0.0)
    return e.select("osm_id", "osm_type", "name", "geometry_source", count("points").alias("n_points"), count("rings").alias("n_rings"), area.alias("area"), registries.is_industrial(F.col("raw_tags")).alias("industrial"))


@query(sql="""WITH f AS (SELECT c_custkey % 50 AS id, 2012 + c_custkey // 50 AS y, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 97) / 1e2 END AS bcm FROM customer WHERE c_custkey % 50 % 10 <> 0),
  l AS (SELECT id, max(y) AS y, arg_max(coalesce(bcm, -1), y) AS bcm, count(DISTINCT CASE WHEN bcm > 0 THEN y END) AS years FROM f GROUP BY 1)
  SELECT concat('ggfr:', id) AS source_id, 20 + id / 1e1 AS lat, 400e0 AS radius_m, CASE WHEN bcm >= 0 THEN printf('flaring in %d: %.4f bcm; %d of %d years', y, bcm, years, (SELECT count(DISTINCT y) FROM f)) END AS status FROM l""")
def flare_volume_loader(spark, sf_dir):
    """Yearly volumes of 50 flares, a tenth of them elsewhere, some years without a number."""
    k = F.col("c_custkey")
    d = staging.table(spark, sf_dir, "customer").select(
        (k % 50).alias("id"), F.when(k % 50 % 10 == 0, "Peru").otherwise(" India").alias("Country"), F.expr("2012 + c_custkey DIV 50").alias("Year"), F.when(k % 9 != 0, ((k % 97) / 100).cast("string")).otherwise("n/a").alias("BCM"),
        (20 + (k % 50) / 10).cast("string").alias("lat"), F.lit("75.5").alias("lon"),
    )
    return registries.flare_volumes(d).select("source_id", "lat", "radius_m", "status")


_FILES = ["global_power_plant_database_{}.csv", "GCPT-coal-plants-{}.csv", "Plant-level Steel {}.xlsx", "flare volumes {}.xlsx", "nightfire_{}.csv", "readme_{}.txt", "mystery_{}.csv"]


@query(sql="SELECT concat('raw/', replace(CASE n_nationkey % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_FILES)) + " END, '{}', n_nationkey::varchar)) AS path, CASE n_nationkey % 7 WHEN 0 THEN 'wri' WHEN 1 THEN 'gem:coal_plant' WHEN 2 THEN 'gem:steel' WHEN 3 THEN 'ggfr' WHEN 4 THEN 'vnf' ELSE 'unrecognised' END AS loader FROM nation WHERE n_nationkey % 7 <> 5")
def file_discovery(spark, sf_dir):
    """A listing of raw files, by the loader that takes each."""
    keys = [r[0] for r in staging.table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # stands for a folder's listing
    found = registries.discovered([f"raw/{_FILES[k % 7].format(k)}" for k in keys])
    rows = [(p, k) if isinstance(p, str) else (p[0], f"{k}:{p[1]}") for k, ps in found.items() for p in ps]
    return spark.createDataFrame(rows, "path string, loader string")


def _government(spark, sf_dir):
    k = F.col("s_suppkey")
    s = staging.table(spark, sf_dir, "supplier").select(k.alias("Record ID"), F.col("s_name").alias("FacilityName"), F.when(k % 5 != 0, (20 + k % 10).cast("string")).alias("Latitude"), F.when(k % 11 == 0, "400").otherwise((70 + k % 7).cast("string")).alias("Long"))
    root = staging.new_path(spark, "government")
    part = lambda i: s.filter(F.col("Record ID") % 4 == i)
    part(0).write.csv(f"{root}/a.csv", header=True)
    part(1).write.csv(f"{root}/b.tsv", header=True, sep="\t")
    part(2).write.json(f"{root}/c.json")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("Long").cast("double"), F.col("Latitude").cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("Record ID", "FacilityName").alias("properties"))
    _document(part(3).select(F.to_json(feature).alias("v")), "v", '{"features":[').write.text(f"{root}/d.geojson")
    return government.ingest(spark, {"csv": f"{root}/a.csv", "tsv": f"{root}/b.tsv", "json": f"{root}/c.json", "geojson": f"{root}/d.geojson", "absent": f"{root}/none.csv", "workbook": f"{root}/e.xlsx"})


_GOOD = "s_suppkey % 5 <> 0 AND s_suppkey % 11 <> 0"


@query(sql=f"SELECT CASE s_suppkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'tsv' WHEN 2 THEN 'json' ELSE 'geojson' END AS source, s_name AS facility_name, (20 + s_suppkey % 10)::double AS lat, (70 + s_suppkey % 7)::double AS lon FROM supplier WHERE {_GOOD}")
def government_files(spark, sf_dir):
    """Files of four kinds, columns in their own spelling; rows without a place or off the globe are left out."""
    return _government(spark, sf_dir)[0].select("source", "facility_name", "lat", "lon")


@query(sql=f"""SELECT CASE s_suppkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'tsv' WHEN 2 THEN 'json' ELSE 'geojson' END AS source, 'read' AS state, count(*) FILTER ({_GOOD}) AS accepted, count(*) FILTER (NOT ({_GOOD})) AS rejected FROM supplier GROUP BY 1
  UNION ALL SELECT 'absent', 'unavailable', 0, 0 UNION ALL SELECT 'workbook', 'unavailable', 0, 0""")
def government_summary(spark, sf_dir):
    return _government(spark, sf_dir)[1].select("source", F.split("status", ":")[0].alias("state"), "accepted", "rejected")


@query("detections", sql="SELECT detection_id FROM detections WHERE lat BETWEEN 15 AND 25 AND lon BETWEEN 75 AND 90 AND acq::date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def point_neighbourhood(spark, sf_dir):
    from emberline.sources import satellite

    d = views.detections(spark, sf_dir)
    return d.join(satellite.around(d, 20.0, 82.5, 7.5, "2024-01-05", "2024-01-20").filter("lat between 15 and 25").select("detection_id"), "detection_id", "left_semi").select("detection_id")


# ---- sinks
@query(sql="SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::bigint AS keys FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def snapshot_publish(spark, sf_dir):
    """Readers see the last committed version, not one that was written only."""
    o, root = staging.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), staging.new_path(spark, "snapshot")
    sinks.publish(o.filter("o_orderkey % 2 = 0"), root, "v1")
    sinks.publish(o.filter("o_orderkey % 3 <> 0"), root, "v2")
    o.limit(5).write.parquet(f"{root}/v3/data")
    return sinks.current(spark, root).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(sql="SELECT 'v1' AS version, count(*) FILTER (o_orderkey % 2 = 0) AS n FROM orders UNION ALL SELECT 'v2', count(*) FILTER (o_orderkey % 3 <> 0) FROM orders")
def change_feed(spark, sf_dir):
    """Commits as a stream; a version without a commit is not announced."""
    o, root = staging.table(spark, sf_dir, "orders").select("o_orderkey"), staging.new_path(spark, "feed")
    sinks.publish(o.filter("o_orderkey % 2 = 0"), root, "v1")
    sinks.publish(o.filter("o_orderkey % 3 <> 0"), root, "v2")
    o.limit(5).write.parquet(f"{root}/v3/data")
    out = staging.new_path(spark, "feed-out")
    live.change_feed(spark, root).writeStream.format("parquet").option("path", out).option("checkpointLocation", staging.new_path(spark, "feed-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("version", "n")


@query(sql="SELECT o_orderkey, o_orderkey % 2 = 0 AS in_first FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def bulk_insert(spark, sf_dir):
    """Two loads of one table: rows that it has already are left alone."""
    o, path = staging.table(spark, sf_dir, "orders").select("o_orderkey"), staging.new_path(spark, "bulk")
    sinks.insert_new(o.filter("o_orderkey % 2 = 0").withColumn("in_first", F.lit(True)), path, "o_orderkey")
    sinks.insert_new(o.filter("o_orderkey % 3 = 0").withColumn("in_first", F.lit(False)), path, "o_orderkey")
    return spark.read.parquet(path)


@query("sites", sql="SELECT site_id, CASE WHEN site_id % 4 = 0 THEN concat('''=', name) ELSE name END AS name, state FROM sites WHERE is_active")
def csv_export_file(spark, sf_dir):
    """Every match of a listing as CSV, safe for spreadsheets, and read back."""
    path = staging.new_path(spark, "export")
    s = serving.sites(views.sites(spark, sf_dir)).select("site_id", F.when(F.col("site_id") % 4 == 0, F.concat(F.lit("="), "name")).otherwise(F.col("name")).alias("name"), "state")
    sinks.write_csv(s, path, "site_id")
    return spark.read.csv(path, header=True, schema="site_id bigint, name string, state string")


_PLAIN = "CASE WHEN {c} = floor({c}) THEN concat({c}::bigint, '.0') ELSE {c}::varchar END"


@query("sites", sql=f"""SELECT concat('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[', {_PLAIN.format(c='lon')}, ',', {_PLAIN.format(c='lat')}, ']}},"properties":{{"site_id":', site_id, ',"name":"', name, '","state":"', state, '"}}}}') AS value FROM sites""")
def site_geojson(spark, sf_dir):
    return serving.geojson(views.sites(spark, sf_dir), ["site_id", "name", "state"])


@query("sites", sql="SELECT site_id, name, lat, lon, balance FROM sites")
def geojson_export_file(spark, sf_dir):
    """Features written to files and parsed back; a missing number is no property."""
    path = staging.new_path(spark, "geojson")
    sinks.write_geojson(views.sites(spark, sf_dir), path, ["site_id", "name", "balance"])
    f = spark.read.text(path).select(F.from_json("value", "geometry struct<coordinates:array<double>>, properties struct<site_id:bigint,name:string,balance:double>").alias("f"))
    return f.select("f.properties.site_id", "f.properties.name", F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"), "f.properties.balance")


@query(sql="SELECT * FROM (VALUES ('csv', 'ok', 1), ('parquet', 'ok', 1), ('parquet', 'unlisted', 1)) v(output, state, n)")
def label_files(spark, sf_dir):
    """Files of a label set against its manifest, with one that came later."""
    d, path = staging.table(spark, sf_dir, "labels").coalesce(1), staging.new_path(spark, "labels")
    sinks.write_labels(d, path)
    d.write.mode("append").parquet(f"{path}/files/parquet")
    return sinks.verified(spark, path).groupBy("output", "state").agg(F.count("*").alias("n"))


@query(sql=thermal_queries.SQL["baseline_monthly_profile"])
def baseline_file(spark, sf_dir):
    """A profile table published with its months as JSON, loaded back."""
    root = staging.new_path(spark, "baseline")
    b = baseline.compute(thermal_queries.assigned(spark, sf_dir), window_days=thermal_queries.WINDOW, exclude_days=thermal_queries.EXCLUDE)
    sinks.publish(b.withColumn("monthly_profile", F.to_json("monthly_profile", {"ignoreNullFields": "false"})), root, "v1")
    back = sinks.current(spark, root).withColumn("monthly_profile", F.from_json("monthly_profile", "array<double>"))
    return back.select("scope", "key", F.array_join(F.transform("monthly_profile", lambda v: F.when(v.isNotNull(), F.format_string("%.4f", v)).otherwise("-")), ",").alias("monthly_profile"))


# ---- single derivations
@query(sql="SELECT n_name, n_nationkey * 100 AS sequence, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey * 60 END::bigint AS lag_s FROM nation")
def replication_lag(spark, sf_dir):
    k = F.col("n_nationkey")
    at = F.date_format(F.lit("2024-03-01 12:00:00").cast("timestamp") - F.make_interval(mins=k.cast("int")), "yyyy-MM-dd'T'HH\\:mm\\:ss'Z'")
    state = F.concat(F.lit("# state\n"), F.when(k % 5 != 0, F.concat(F.lit("timestamp="), at, F.lit("\n"))).otherwise(""), F.lit("sequenceNumber="), (k * 100).cast("string"), F.lit("\n"))
    d = staging.table(spark, sf_dir, "nation").select("n_name", state.alias("state"))
    return pipelines.replication_state(d, "state", F.lit("2024-03-01 12:00:00").cast("timestamp")).select("n_name", "sequence", "lag_s")


@query(sql="WITH c AS (SELECT o_orderkey, o_custkey % 40 AS k, epoch(o_orderdate)::bigint // 86400 AS d FROM orders) SELECT o_orderkey, count(*) OVER (PARTITION BY k ORDER BY d RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) > 8 AS refused FROM c")
def rate_limits(spark, sf_dir):
    """Days stand for seconds: more than eight calls of a key in sixty."""
    o = staging.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("key"), F.timestamp_seconds(F.expr("unix_timestamp(cast(o_orderdate as timestamp)) DIV 86400")).alias("ts"))
    return pipelines.rate_limited(o, 8).select("o_orderkey", "refused")


@query(sql="SELECT o_orderkey AS alert_id, CASE WHEN o_orderkey % 3 = 0 THEN 'first_detection,peak,alert_created' ELSE 'first_detection,alert_created,peak,decision' END AS kinds FROM orders")
def alert_timeline(spark, sf_dir):
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    a = staging.table(spark, sf_dir, "orders").select(k.alias("alert_id"), t.alias("first_seen"), (t + F.make_interval(hours=F.when(k % 3 == 0, 1).otherwise(3))).alias("peak_at"), (t + F.make_interval(hours=F.lit(2))).alias("created_at"), F.when(k % 3 != 0, t + F.make_interval(hours=F.lit(4))).alias("decided_at"), F.col("o_totalprice").alias("frp_max"), F.lit("high").alias("severity"), F.lit("confirmed").alias("decision"))
    return alerts.timeline(a).select("alert_id", F.array_join(F.transform("timeline", lambda e: e["kind"]), ",").alias("kinds"))


_GEOCODED = "SELECT o_custkey AS incident_id, o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN 'building' WHEN 1 THEN 'landuse' WHEN 2 THEN 'place' ELSE 'highway' END AS class, CASE WHEN o_orderkey % 8 = 2 THEN 'locality' ELSE 'facility' END AS query_kind, (o_orderkey % 40) / 2e0 AS extent_km FROM orders"


@query(sql=f"""WITH h AS ({_GEOCODED}), q AS (SELECT *, CASE WHEN class = 'building' THEN 3 WHEN class = 'landuse' THEN 2 WHEN class = 'place' AND query_kind = 'locality' THEN 1 END AS r FROM h)
  SELECT incident_id, ord, CASE r WHEN 3 THEN 'facility' WHEN 2 THEN 'industrial_area' ELSE 'locality' END AS quality, least(greatest(extent_km / 2, 3e-1), 8e0) AS radius_km FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY r DESC, ord) AS rn FROM q WHERE r IS NOT NULL) x WHERE rn = 1""")
def best_geocode(spark, sf_dir):
    h = views._view(spark, sf_dir, _GEOCODED, "orders")
    return pipelines.best_geocode(h).select("incident_id", "ord", "quality", "radius_km")


@query(sql="SELECT concat('v', n_nationkey) AS version, n_nationkey / 1e2 AS macro_f1, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 1e1 END AS threshold FROM nation")
def model_cards(spark, sf_dir):
    """Headline numbers and the point of a quarter false alarm a day, from nested JSON that may lack it."""
    k = F.col("n_nationkey")
    point = lambda rate, th: F.struct(F.lit(rate).alias("false_alarms_per_day"), th.alias("threshold"), F.lit(0.5).alias("recall"))
    points = F.when(k % 2 == 0, F.array(point(1.0, F.lit(0.9)), point(0.25, k / 10))).otherwise(F.array(point(1.0, F.lit(0.9))))
    m = staging.table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.concat(F.lit("v"), k.cast("string")).alias("version"), (k / 100).alias("macro_f1"), points.alias("operating_points"))).alias("metrics"))
    return pipelines.model_card(m).select("version", "macro_f1", "threshold")


@query(sql="WITH p AS (SELECT n_regionkey, 'old' AS k, 'a' AS v FROM nation UNION SELECT n_regionkey, 'both', 'b' FROM nation WHERE n_regionkey % 2 = 1 UNION SELECT n_regionkey, 'both', 'a' FROM nation WHERE n_regionkey % 2 = 0 UNION SELECT n_regionkey, 'new', 'b' FROM nation WHERE n_regionkey % 2 = 1) SELECT n_regionkey AS key, string_agg(concat(k, '=', v), ',' ORDER BY k) AS status FROM p GROUP BY 1")
def status_merge(spark, sf_dir):
    keys = staging.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("key")).distinct()
    status = lambda *kv: F.create_map(*map(F.lit, kv)).alias("status")
    m = pipelines.merged_status(keys.select("key", status("old", "a", "both", "a")), keys.filter("key % 2 = 1").select("key", status("both", "b", "new", "b")))
    return m.select("key", F.array_join(F.transform(F.array_sort(F.map_entries("status")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("status"))


@query("sites", sql="SELECT site_id, round(balance, 1) AS balance FROM sites")
def static_listing(spark, sf_dir):
    return pipelines.slim(views.sites(spark, sf_dir), ["site_id", "balance"], 1)


@query("admin_areas", sql="SELECT p.area_id AS parent_id, c.area_id AS child_id FROM admin_areas p JOIN admin_areas c ON (c.xmin + 5e-1) >= p.xmin AND (c.xmin + 5e-1) < p.xmax AND (c.ymin + 5e-1) >= p.ymin AND (c.ymin + 5e-1) < p.ymax")
def areas_inside(spark, sf_dir):
    """Small areas in the corner of large ones, found by their centroid."""
    a = views.admin_areas(spark, sf_dir)
    at = lambda x, y: F.struct((F.col("xmin") + x).alias("x"), (F.col("ymin") + y).alias("y"))
    child = a.select("area_id", F.array(F.array(at(0.0, 0.0), at(1.0, 0.0), at(1.0, 1.0), at(0.0, 1.0), at(0.0, 0.0))).alias("rings"))
    return pipelines.areas_inside(a, child)


@query(sql="SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Cement' WHEN 1 THEN 'Power' WHEN 2 THEN 'Cement' ELSE 'Other Industrial' END AS industry_type FROM supplier")
def mapped_industries(spark, sf_dir):
    """The first tag key in order decides, where the table knows its value."""
    k = F.col("s_suppkey")
    pairs = F.when(k % 4 == 0, F.create_map(F.lit("power"), F.lit("plant"), F.lit("industrial"), F.lit("cement"))).when(k % 4 == 1, F.create_map(F.lit("power"), F.lit("plant"), F.lit("industrial"), F.lit("yes"))).when(k % 4 == 2, F.create_map(F.lit("industrial"), F.lit("cement"), F.lit("note"), F.lit("plant"))).otherwise(F.create_map(F.lit("amenity"), F.lit("plant")))
    table = spark.createDataFrame([("industrial", "cement", "Cement"), ("power", "plant", "Power"), ("amenity", "plant", "None")], "tag_key string, tag_value string, industry_type string")
    return facilities.mapped_industry(staging.table(spark, sf_dir, "supplier").select("s_suppkey", pairs.alias("tags")), table, "s_suppkey").select("s_suppkey", "industry_type")


# ---- geometry
@query("facilities", sql="SELECT ref, round(lat, 6) AS lat, round(lon, 6) AS lon FROM facilities")
def utm_round_trip(spark, sf_dir):
    """Easting and northing and back."""
    f = views.facilities(spark, sf_dir).withColumn("zone", geo.utm_zone("lon"))
    east, north = geo.utm_xy("lat", "lon", F.col("zone"))
    lat, lon = geo.utm_inverse("east", "north", F.col("zone"))
    return f.withColumns({"east": east, "north": north}).select("ref", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def _rings(spark, sf_dir):
    k = F.col("n_nationkey")
    ring = lambda *ps: F.array(*[F.struct((k + float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ps])
    hole = F.struct(F.lit(None).cast("double").alias("x"), F.lit(0.0).alias("y"))
    shape = (
        F.when(k % 5 == 0, ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))).when(k % 5 == 1, ring((0, 0), (2, 0), (2, 2), (0, 2)))
        .when(k % 5 == 2, F.concat(ring((0, 0), (0, 0), (2, 0)), F.array(hole), ring((2, 0), (2, 2), (0, 2), (0, 0)))).when(k % 5 == 3, ring((0, 0), (2, 2), (2, 0), (0, 3), (0, 0))).otherwise(ring((0, 0), (1, 1), (0, 0)))
    )
    return staging.table(spark, sf_dir, "nation").select("n_name", shape.alias("ring"))


@query(sql="SELECT n_name, CASE WHEN n_nationkey % 5 < 3 THEN 5 END AS points, CASE WHEN n_nationkey % 5 < 3 THEN 4e0 END AS area FROM nation")
def ring_repair(spark, sf_dir):
    """Open rings, repeated and missing points are mended; crossing sides and rings without an area are rejected."""
    fixed = _rings(spark, sf_dir).withColumn("ring", geo.repaired_ring(F.col("ring")))
    return fixed.select("n_name", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("points"), F.abs(geo.ring_area(F.col("ring"))).alias("area"))


@query(sql="SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 5 ELSE 9 END AS points FROM nation")
def ring_simplification(spark, sf_dir):
    """Middles of the sides of a square, off them by a tenth, and by three tenths: over the tolerance."""
    k = F.col("n_nationkey")
    off = F.when(k % 2 == 0, 0.1).otherwise(0.3)
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    z, one, two = F.lit(0.0), F.lit(1.0), F.lit(2.0)
    ring = F.array(p(z, z), p(one, -off), p(two, z), p(two + off, one), p(two, two), p(one, two + off), p(z, two), p(-off, one), p(z, z))
    return staging.table(spark, sf_dir, "nation").select("n_name", F.size(geo.simplified(ring, 0.2)).alias("points"))


@query("facilities", sql=f"+f AS (SELECT ref, CASE ref % 4 WHEN 0 THEN 72 + ref % 10 / 1e1 WHEN 1 THEN -(72 + ref % 10 / 1e1) WHEN 2 THEN 885e-1 ELSE 0e0 END AS lat, CASE ref % 4 WHEN 3 THEN CASE WHEN ref % 8 = 3 THEN 17999e-2 ELSE -17999e-2 END ELSE ref * 37 % 360 - 180 END + ref % 3 / 1e2 AS lon FROM facilities) SELECT l.ref AS a, r.ref AS b FROM f l JOIN f r ON l.ref < r.ref WHERE {thermal_queries._hav('l', 'r')} <= 150000")
def polar_pairs(spark, sf_dir):
    """Pairs within 150 km in high latitudes, near a pole and across the date line."""
    n = F.col("ref")
    lat = F.when(n % 4 == 0, 72 + n % 10 / 10).when(n % 4 == 1, -(72 + n % 10 / 10)).when(n % 4 == 2, 88.5).otherwise(0.0)
    lon = F.when(n % 4 == 3, F.when(n % 8 == 3, 179.99).otherwise(-179.99)).otherwise(n * 37 % 360 - 180) + n % 3 / 100
    f = views.facilities(spark, sf_dir).select("ref", lat.alias("lat"), lon.alias("lon"))
    right = f.select(*[F.col(c).alias(f"r_{c}") for c in f.columns])
    return spatial.pairs_within(f, right, 150_000.0).filter("ref < r_ref").select(F.col("ref").alias("a"), F.col("r_ref").alias("b"))


@query("facilities", sql=f"+p AS (SELECT ref, CASE WHEN ref % 2 = 0 THEN -60 - ref % 25 ELSE 50 + ref % 39 END::double AS lat, (ref * 53 % 360 - 180)::double AS lon FROM facilities) SELECT p.ref, round(min({thermal_queries._hav('p', 'f')}), 2) AS distance_m FROM p CROSS JOIN facilities f GROUP BY 1")
def nearest_far_away(spark, sf_dir):
    """The nearest facility of points all over the globe, thousands of kilometres off."""
    n = F.col("ref")
    p = views.facilities(spark, sf_dir).select("ref", F.when(n % 2 == 0, -60 - n % 25).otherwise(50 + n % 39).cast("double").alias("lat"), (n * 53 % 360 - 180).cast("double").alias("lon")).withColumnRenamed("ref", "k")
    return spatial.nearest_facility(p, views.facilities(spark, sf_dir), "k").select(F.col("k").alias("ref"), F.round("distance_m", 2).alias("distance_m"))
