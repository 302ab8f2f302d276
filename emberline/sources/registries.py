"""Loaders of facility registries; each ends in facilities.finished with the columns of RECORD."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import geo
from emberline.operators.facilities import finished, thermal_kind

BOX = (5.0, 67.0, 38.0, 99.0)
RECORD = ["source", "source_id", "name", "kind", "lat", "lon", "radius_m", "capacity_mw", "status", "fuel", "url", "footprint"]
# Fuels with heat, tracker kinds, file-name patterns, kept states and their rank, column aliases.
THERMAL_FUELS = ["coal", "gas", "oil", "biomass", "waste", "petcoke", "cogeneration", "nuclear", "other"]
TRACKERS = {"coal_plant": "power_thermal", "gas_plant": "power_thermal", "steel": "steel_metal", "coal_mine": "mining_quarry", "cement": "cement", "oil_gas_extraction": "refinery_petrochem"}
FILE_PATTERNS = [
    (r"coal.?plant|gcpt", "coal_plant"),
    (r"coal.?mine|gcmt", "coal_mine"),
    (r"steel|gist", "steel"),
    (r"cement|gcct", "cement"),
    (r"oil.?and.?gas.?plant|gogpt", "gas_plant"),
    (r"extraction|goget", "oil_gas_extraction"),
]
STATUS_RANK = {"operating": 0, "operating pre-retirement": 0, "active": 0, "construction": 1, "in construction": 1, "under construction": 1, "mothballed": 2, "idle": 2, "": 3}
ALIASES = {
    "lat": ("latitude", "lat", "y"),
    "lon": ("longitude", "lon", "lng", "x"),
    "name": ("plant name", "plant name (english)", "name", "unit name", "mine name", "project name", "facility name", "plant"),
    "id": ("gem location id", "gem plant id", "gem unit/phase id", "gem unit id", "gem mine id", "gem id", "plant id", "id", "gppd_idnr", "unit id"),
    "status": ("status", "plant status", "operating status", "capacity operating status"),
    "capacity": ("capacity (mw)", "capacity_mw", "nominal crude steel capacity (ttpa)", "capacity (mtpa)", "capacity", "capacity (bcm/y)"),
    "country": ("country", "country/area", "country_long", "country_name"),
    "url": ("url", "wiki url", "wiki page", "gem wiki page (eng)"),
}


def meanings(df: DataFrame) -> dict[str, Column]:
    """Columns of df by what they hold, one pass over their names; of several aliases the first listed one wins."""
    best: dict[str, tuple[int, Column]] = {}
    for c in df.columns:
        alias = c.strip().lower()
        for key in (k for k, listed in ALIASES.items() if alias in listed):
            place = ALIASES[key].index(alias)
            if key not in best or place < best[key][0]:
                best[key] = place, F.col(f"`{c}`")
    return {key: c for key, (_, c) in best.items()}


def _record(df: DataFrame, source: str) -> DataFrame:
    kinds = {"radius_m": "double", "capacity_mw": "double"}
    d = df.withColumns({c: F.lit(None).cast(kinds.get(c, "string")) for c in RECORD if c not in df.columns and c != "source"})
    return finished(d, source, BOX).select(*RECORD)


def power_plants(df: DataFrame, countries: Sequence[str] = ("india", "ind")) -> DataFrame:
    """Power-plant table: plants of a thermal fuel in the country."""
    country = "country_long" if "country_long" in df.columns else "country"
    d = df.filter(F.lower(country).isin(*countries) & F.lower("primary_fuel").isin(THERMAL_FUELS))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    url = F.col("url") if "url" in df.columns else F.lit(None).cast("string")
    d = d.select(F.col("gppd_idnr").cast("string").alias("source_id"), "name", F.lit("power_thermal").alias("kind"), number("latitude"), number("longitude"), number("capacity_mw"), F.col("primary_fuel").alias("fuel"), url.alias("url"))
    return _record(d.withColumnsRenamed({"latitude": "lat", "longitude": "lon"}), "wri_gppd")


def tracker(df: DataFrame, name: str, countries: Sequence[str] = ("india", "ind", "in")) -> DataFrame:
    """A unit-level tracker: units of one place add up, the most advanced unit gives name and status."""
    if name not in TRACKERS:
        raise ValueError(f"trackers: {sorted(TRACKERS)}")
    known = meanings(df)
    lat, lon = known.get("lat"), known.get("lon")
    if lat is None or lon is None:
        joint = [c for c in df.columns if c.lower().strip() in ("coordinates", "coordinate", "lat/lon")]
        if not joint:
            raise ValueError("no coordinates")
        parts = F.split(F.col(f"`{joint[0]}`"), ",", 2)
        lat, lon = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    optional = lambda key, kind="string": known[key].try_cast(kind) if key in known else F.lit(None).cast(kind)
    status, rank = F.lower(F.trim(F.coalesce(optional("status"), F.lit("")))), F.create_map(*[F.lit(x) for k, v in STATUS_RANK.items() for x in (k, v)])
    lat, lon = F.bround(lat.try_cast("double"), 5), F.bround(lon.try_cast("double"), 5)
    ident = optional("id") if "id" in known else F.concat_ws(",", lat.cast("string"), lon.cast("string"))
    d = df.filter(F.lower(F.trim(optional("country"))).isin(*countries)) if "country" in known else df
    d = d.filter(status.isin(*STATUS_RANK)).select(F.concat(F.lit(f"{name}:"), ident).alias("source_id"), optional("name").alias("name"), lat.alias("lat"), lon.alias("lon"), optional("capacity", "double").alias("capacity_mw"), F.nullif(status, F.lit("")).alias("status"), optional("url").alias("url"), F.try_element_at(rank, status).alias("rank"))
    best = F.struct("rank", F.coalesce("name", F.lit("~")), "lat", "lon")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), best)).alias(c)
    d = d.groupBy("source_id").agg(*[first(c) for c in ("name", "lat", "lon", "status", "url")], F.sum("capacity_mw").alias("capacity_mw"))
    return _record(d.withColumn("kind", F.lit(TRACKERS[name])), "gem")


def flare_nights(df: DataFrame, min_days: int = 5, min_temp_k: float = 1400.0, cell_deg: float = 0.005) -> DataFrame:
    """Hot night observations to persistent flare sites: cells with enough distinct nights."""
    names = {c.lower(): c for c in df.columns}
    col = lambda *options: next((F.col(names[o]) for o in options if o in names), None)
    lat, lon, temp, date = col("lat_gmtco", "latitude", "lat"), col("lon_gmtco", "longitude", "lon"), col("temp_bb"), col("date_mscan", "date")
    if lat is None or lon is None:
        raise ValueError("no coordinates")
    d = df.withColumns({"_lat": lat.try_cast("double"), "_lon": lon.try_cast("double")}).filter("_lat is not null and _lon is not null")
    d = d.filter(temp.try_cast("double") >= min_temp_k) if temp is not None else d
    cell = F.concat_ws("_", *[F.bround(F.col(c) / cell_deg).cast("long").cast("string") for c in ("_lat", "_lon")])
    d = d.groupBy(cell.alias("cell")).agg(F.avg("_lat").alias("lat"), F.avg("_lon").alias("lon"), (F.countDistinct(date) if date is not None else F.lit(None).cast("long")).alias("days"))
    d = d.filter(F.col("days") >= min_days) if date is not None else d
    return _record(d.select(F.concat(F.lit("vnf:"), "cell").alias("source_id"), F.lit("gas_flare").alias("kind"), "lat", "lon", F.when(F.col("days").isNotNull(), F.concat(F.col("days").cast("string"), F.lit(" nights"))).alias("status")), "vnf")


def flare_volumes(df: DataFrame, country: str = "india") -> DataFrame:
    """Yearly flare volumes: the latest year of each flare, and in how many years it burned."""
    d = df.filter(F.lower(F.trim("Country")) == country).withColumn("_bcm", F.col("BCM").try_cast("double"))
    total = F.broadcast(d.agg(F.countDistinct("Year").alias("_total")))
    g = d.groupBy("id").agg(F.max_by(F.struct("Year", "lat", "lon", "_bcm"), "Year").alias("l"), F.countDistinct(F.when(F.col("_bcm") > 0, F.col("Year"))).alias("years")).join(total)
    status = F.when(F.col("l._bcm").isNotNull(), F.format_string("flaring in %d: %.4f bcm; %d of %d years", F.col("l.Year").cast("int"), F.col("l._bcm"), "years", "_total"))
    return _record(g.select(F.concat(F.lit("ggfr:"), F.col("id").cast("string")).alias("source_id"), F.lit("gas_flare").alias("kind"), F.col("l.lat").try_cast("double").alias("lat"), F.col("l.lon").try_cast("double").alias("lon"), status.alias("status")), "ggfr")


def map_features(spark: SparkSession, path: str) -> DataFrame:
    """Points of a feature collection, kind from the property or the tags, radius from footprint, bounds or kind."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<source_ref:string,name:string,kind:string,tags:map<string,string>,bounds:struct<minlat:double,minlon:double,maxlat:double,maxlon:double>,ring:array<struct<x:double,y:double>>>>>"
    d = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).filter("f.geometry.type = 'Point'")
    p = F.col("f.properties")
    d = d.select(p["source_ref"].alias("source_id"), p["name"].alias("name"), F.coalesce(p["kind"], thermal_kind(F.coalesce(p["tags"], F.create_map().cast("map<string,string>")))).alias("kind"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"), p["bounds"].alias("b"), p["ring"].alias("ring")).filter("kind is not null")
    dy, dx = (F.col("b.maxlat") - F.col("b.minlat")) * 110_540.0, (F.col("b.maxlon") - F.col("b.minlon")) * geo.METRES_PER_DEGREE * F.cos(F.radians("lat"))
    radius = F.coalesce(F.when(geo.ring_valid(F.col("ring")), geo.equivalent_radius_m(F.col("ring"))), F.when((dx > 0) & (dy > 0), F.sqrt(dx * dy / 3.141592653589793)))
    return _record(d.withColumn("radius_m", radius), "osm")


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements as geometry arrays: a node is a point, a closed way of four points or more a ring, an open one a line,
    a relation the rings stitched from its members, else its centre; what has no geometry is dropped."""
    point = "struct<lat:double,lon:double>"
    schema = f"elements array<struct<type:string,id:bigint,lat:double,lon:double,timestamp:string,version:int,changeset:bigint,tags:map<string,string>,geometry:array<{point}>,center:{point},members:array<struct<type:string,role:string,geometry:array<{point}>>>>>"
    d = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    xy = lambda a: F.transform(F.filter(a, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    own = F.when(F.col("type") == "node", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))))).otherwise(xy("geometry"))
    ways = lambda inner: F.transform(F.filter("members", lambda m: (m["type"] == "way") & ((F.coalesce(m["role"], F.lit("")) == "inner") if inner else (F.coalesce(m["role"], F.lit("")) != "inner"))), lambda m: xy(m["geometry"]))
    d = d.withColumns({"points": own, "outer": stitched(ways(False)), "inner": stitched(ways(True))})
    closed = (F.size("points") >= 4) & (F.element_at("points", 1) == F.element_at("points", -1))
    rings = F.when(closed, F.array("points")).when((F.col("type") == "relation") & (F.size("outer") > 0), F.concat("outer", F.coalesce("inner", F.array().cast("array<array<struct<x:double,y:double>>>"))))
    centre = F.when(F.col("center").isNotNull(), F.array(F.struct(F.col("center.lon").alias("x"), F.col("center.lat").alias("y"))))
    d = d.withColumns({"rings": rings, "points": F.when(rings.isNull(), F.when(F.size("points") >= F.when(F.col("type") == "node", 1).otherwise(2), F.col("points")).otherwise(centre))})
    source = F.when(F.col("type") != "relation", F.col("type")).when(F.col("rings").isNotNull() | (F.size("points") > 1), "relation_reconstructed").otherwise("relation_center_fallback")
    return d.filter("rings is not null or points is not null").select(F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), F.col("tags")["name"].alias("name"), F.col("version").alias("osm_version"), F.col("changeset").alias("osm_changeset"), F.try_to_timestamp("timestamp").alias("source_timestamp"), F.col("tags").alias("raw_tags"), source.alias("geometry_source"), "points", "rings")


def stitched(ways: Column) -> Column:
    """Rings from ways that meet at their ends, in Arrow batches; ways that close no ring are left out."""
    def join(lines: list[list[tuple]]) -> list[list[tuple]]:
        rings, rest = [], [list(x) for x in lines if len(x) > 1]
        while rest:
            line = rest.pop()
            grown = True
            while grown and line[0] != line[-1]:
                grown = False
                for k, other in enumerate(rest):
                    if other[0] == line[-1]:
                        line += other[1:]
                    elif other[-1] == line[-1]:
                        line += other[-2::-1]
                    else:
                        continue
                    rest.pop(k)
                    grown = True
                    break
            if len(line) >= 4 and line[0] == line[-1]:
                rings.append(line)
        return rings

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else [[{"x": x, "y": y} for x, y in r] for r in join([[(p["x"], p["y"]) for p in w] for w in v])])

    return F.pandas_udf(run, "array<array<struct<x:double,y:double>>>")(ways)


def is_industrial(tags: Column) -> Column:
    """Selection rule of the continuous feed."""
    t = lambda k: F.try_element_at(tags, F.lit(k))
    return F.coalesce((t("landuse") == "industrial") | t("industrial").isNotNull() | (t("man_made").isin("works", "wastewater_plant", "water_works", "flare")) | (t("building") == "industrial") | (t("power") == "plant"), F.lit(False))


def discovered(paths: Sequence[str]) -> dict[str, list]:
    """Files by loader, from their names."""
    out: dict[str, list] = {"wri": [], "gem": [], "vnf": [], "ggfr": [], "unrecognised": []}
    for p in sorted(paths):
        name = p.lower().rsplit("/", 1)[-1]
        if not name.endswith((".csv", ".xlsx", ".xls")):
            continue
        kind = next((t for pattern, t in FILE_PATTERNS if re.search(pattern, name)), None)
        if "power_plant_database" in name:
            out["wri"].append(p)
        elif not name.endswith(".csv") and re.search(r"flare.?(volume|location|sites)|ggfr|gfmr", name):
            out["ggfr"].append(p)
        elif "vnf" in name or "nightfire" in name or "/vnf/" in p.lower():
            out["vnf"].append(p)
        elif kind:
            out["gem"].append((p, kind))
        else:
            out["unrecognised"].append(p)
    return out


def with_authority(df: DataFrame) -> DataFrame:
    """Adds source_count and authoritative from the comma list of sources."""
    from emberline.operators.facilities import AUTHORITATIVE

    parts = F.split("sources", ",")
    return df.withColumns({"source_count": F.size(parts), "authoritative": F.arrays_overlap(parts, F.array(*map(F.lit, AUTHORITATIVE)))})
