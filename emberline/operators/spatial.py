"""Distance joins as equi joins on grid buckets, refined by the exact distance.

Rows of buckets are bands of latitude as high as the reach. Each band is cut into whole numbers of buckets around the
globe, as wide as the reach is at the band's and its neighbours' highest latitude: few of them near the poles, and the
last one next to the first. One side is repeated for the neighbouring buckets in its own band and the two beside it.
Catalyst sees an equi join, so it may broadcast a small side, sort-merge two large ones, and split skewed buckets at run
time. Longitudes are taken modulo 360; rows without a place match nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline import staging
from emberline.functions import geo

#: Widest facility radius plus the pixel buffer: no assignment reaches further.
MAX_REACH_M = 6500.0
PIXEL_BUFFER_M = 500.0
#: A degree on the 6 371 km sphere is 111 194.9 m; this leaves room for rounding.
_DEGREE_M = 111_000.0


def _band(lat: str, reach_m: float) -> Column:
    return F.floor(F.col(lat) / (reach_m / _DEGREE_M))


def _buckets_around(band: Column, reach_m: float) -> Column:
    """Number of buckets of a band: none is narrower than two points in reach, here or one band on, can be apart."""
    height = reach_m / _DEGREE_M
    top = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * height, F.lit(90.0))
    half = math.sin(min(reach_m / 2 / geo.EARTH_M * 1.002, math.pi / 2)) / F.greatest(F.cos(F.radians(top)), F.lit(1e-9))
    apart = F.when(half < 1, 2 * F.degrees(F.asin(F.least(half, F.lit(1.0))))).otherwise(360.0)
    return F.greatest(F.floor(360.0 / apart), F.lit(1).cast("long"))


def _bucket(lon: str, number: Column) -> Column:
    turned = F.pmod(F.col(lon) + 180.0, F.lit(360.0))
    return F.least(F.floor(turned / 360.0 * number), number - 1)


def bucketed(df: DataFrame, lat: str, lon: str, reach_m: float) -> DataFrame:
    return df.withColumn("_by", _band(lat, reach_m)).withColumn("_bx", _bucket(lon, _buckets_around(F.col("_by"), reach_m)))


def around(df: DataFrame, lat: str, lon: str, reach_m: float) -> DataFrame:
    """df once for each of the buckets, nine at most, that a point in reach may lie in."""
    d = df.withColumn("_by", F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: _band(lat, reach_m) + k)))
    d = d.withColumn("_n", _buckets_around(F.col("_by"), reach_m)).withColumn("_own", _bucket(lon, F.col("_n")))
    near = F.array_distinct(F.transform(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]), lambda k: F.pmod(F.col("_own") + k, F.col("_n"))))
    return d.withColumn("_bx", F.explode(near)).drop("_n", "_own")


def pairs_within(left: DataFrame, right: DataFrame, reach_m: float, distance: str = "distance_m") -> DataFrame:
    """left (lat, lon, ...) with each right (r_lat, r_lon, ...) at most reach_m away."""
    joined = bucketed(left, "lat", "lon", reach_m).join(around(right, "r_lat", "r_lon", reach_m), ["_by", "_bx"]).drop("_by", "_bx")
    return joined.withColumn(distance, geo.haversine_m("lat", "lon", "r_lat", "r_lon")).filter(F.col(distance) <= reach_m)


def places_within(left: DataFrame, right: DataFrame, reach_m: float, distance: str = "distance_m") -> DataFrame:
    """lat, lon, r_lat, r_lon and distance of the different places of left and right at most reach_m apart."""
    return pairs_within(left.select("lat", "lon").distinct(), right.select("r_lat", "r_lon").distinct(), reach_m, distance)


#: Rows of one place that stand in one block.
PLACE_BLOCK = 256


def _place_blocks(df: DataFrame, lat: str, lon: str, rows: str) -> DataFrame:
    """df in blocks of so many rows of one place: an array of each other column, missing values included, and the number
    of rows. Arrays that nobody reads are not gathered."""
    rest = [F.transform(F.collect_list(F.struct(F.col(c).alias("v"))), lambda x: x["v"]).alias(c) for c in df.columns if c not in (lat, lon)]
    number = F.row_number().over(W.partitionBy(lat, lon).orderBy(F.lit(1))) - 1
    numbered = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_block", F.floor(number / PLACE_BLOCK))
    return numbered.groupBy(lat, lon, "_block").agg(F.count("*").cast("int").alias(rows), *rest)


def _frequent(left: DataFrame, right: DataFrame, reach_m: float, tasks: int) -> list[tuple]:
    """_by, _bx and parts of the buckets with more than a task's share of the pairs of rows: no more than there are tasks.
    Both sides of such a bucket go into so many parts, and each part of one meets each of the other."""
    places = right.groupBy("r_lat", "r_lon").agg(F.count("*").alias("_rows"))
    r = around(places, "r_lat", "r_lon", reach_m).groupBy("_by", "_bx").agg(F.sum("_rows").alias("_r"))
    l = bucketed(left.select("lat", "lon"), "lat", "lon", reach_m).groupBy("_by", "_bx").agg(F.count("*").cast("double").alias("_l"))
    pairs = staging.persisted(l.join(r, ["_by", "_bx"]).select("_by", "_bx", (F.col("_l") * F.col("_r")).alias("_pairs")), "bucket-pairs")
    share = (pairs.agg(F.sum("_pairs")).first()[0] or 0.0) / tasks
    return [(y, x, math.ceil(math.sqrt(n / share))) for y, x, n in pairs.filter(F.col("_pairs") > share).collect()]


def pairs_by_place(left: DataFrame, right: DataFrame, reach_m: float, distance: str = "distance_m") -> DataFrame:
    """The pairs of pairs_within, for tables with many rows at one place: distances are taken once between blocks of rows
    of one place, and no pair of rows is made that is not in reach. Only blocks are shuffled, not the rows of one side
    with each place of the other; buckets are dealt over all tasks, frequent ones in parts."""
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    l = bucketed(_place_blocks(left, "lat", "lon", "_l_rows"), "lat", "lon", reach_m)
    r = around(_place_blocks(right, "r_lat", "r_lon", "_r_rows"), "r_lat", "r_lon", reach_m)
    keys = ["_by", "_bx"]
    if frequent := _frequent(left, right, reach_m, tasks):
        parts = spark.createDataFrame(frequent, "_by long, _bx long, _parts long")

        def dealt(df: DataFrame, own: str, other: str, *block: str) -> DataFrame:
            n = F.coalesce("_parts", F.lit(1).cast("long"))
            d = df.join(F.broadcast(parts), ["_by", "_bx"], "left").withColumns({own: F.pmod(F.xxhash64(*block), n), "_each": F.sequence(F.lit(0).cast("long"), n - 1)})
            return d.withColumn(other, F.explode("_each")).drop("_parts", "_each")

        l, r, keys = dealt(l, "_lp", "_rp", "lat", "lon", "_block"), dealt(r, "_rp", "_lp", "r_lat", "r_lon", "_block"), [*keys, "_lp", "_rp"]
    l, r = l.drop("_block").repartition(tasks, *keys), r.drop("_block").repartition(tasks, *keys)
    near = l.join(r, keys).withColumn(distance, geo.haversine_m("lat", "lon", "r_lat", "r_lon")).filter(F.col(distance) <= reach_m)
    mine, other = ([F.get(c, F.col("_i")).alias(c) for c in d.columns if c not in at] for d, at in ((left, ("lat", "lon")), (right, ("r_lat", "r_lon"))))
    index = lambda rows: F.sequence(F.lit(0), F.col(rows) - 1)
    # transform() has no generated code, which would hold all pairs of two blocks at once
    one = near.select("*", F.explode(F.transform(index("_l_rows"), lambda i: i)).alias("_i"))
    one = one.select("lat", "lon", *mine, "r_lat", "r_lon", "_r_rows", *[c for c in right.columns if c not in ("r_lat", "r_lon")], distance)
    return one.select("*", F.explode(index("_r_rows")).alias("_i")).select("lat", "lon", *[c for c in left.columns if c not in ("lat", "lon")], "r_lat", "r_lon", *other, distance)


def self_edges(points: DataFrame, key: str, reach_m: float) -> DataFrame:
    """Edges a < b of points (key, lat, lon) at most reach_m apart. Points at one place meet through the smallest key."""
    places = points.groupBy("lat", "lon").agg(F.min(key).alias("first"))
    same = points.join(places, ["lat", "lon"]).filter(F.col(key) > F.col("first")).select(F.col("first").alias("a"), F.col(key).alias("b"))
    right = places.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("first").alias("r_first"))
    near = pairs_within(places, right, reach_m).filter("first < r_first").select(F.col("first").alias("a"), F.col("r_first").alias("b"))
    return same.unionByName(near)


def facility_columns(facilities: DataFrame) -> DataFrame:
    return facilities.select(*[F.col(c).alias(f"r_{c}") for c in facilities.columns])


def match_facilities(points: DataFrame, facilities: DataFrame, key: str) -> DataFrame:
    """key, facility and distance of the facility with the widest margin, radius + buffer - distance, if not negative."""
    near = pairs_within(points.select(key, "lat", "lon"), facility_columns(facilities.select("ref", "lat", "lon", "radius_m")), MAX_REACH_M)
    near = near.withColumn("margin", F.col("r_radius_m") + PIXEL_BUFFER_M - F.col("distance_m")).filter("margin >= 0")
    best = near.groupBy(key).agg(F.max(F.struct("margin", (-F.col("r_ref")).alias("tie"), "r_ref", "distance_m")).alias("best"))
    return best.select(key, F.col("best.r_ref").alias("ref"), F.col("best.distance_m").alias("distance_m"))


#: Reaches that are tried in turn; what finds nothing within the last goes by degree cells.
RINGS_M = (20_000.0, 80_000.0)


def nearest_facility(points: DataFrame, facilities: DataFrame, key: str) -> DataFrame:
    """key, ref and distance of the nearest facility, however far (the smallest ref of equals; nulls without facilities).

    Rings first: places that find nothing within one go on to the next, from a written table. Those that are farther
    from every facility choose among whole degree cells: of the cells with facilities (64,800 at most, so their list is
    broadcast) each cell of places keeps those that may hold the nearest one, and these are joined by cell.
    """
    fac = facilities.select("ref", "lat", "lon").filter("lat is not null and lon is not null")
    rest = staging.persisted(points.select("lat", "lon").filter("lat is not null and lon is not null").distinct(), "places")
    best = lambda d: d.groupBy("lat", "lon").agg(F.min(F.struct("distance_m", "r_ref")).alias("m")).select("lat", "lon", F.col("m.r_ref").alias("ref"), F.col("m.distance_m").alias("distance_m"))
    found = []
    for reach in RINGS_M:
        found.append(staging.persisted(best(pairs_within(rest, facility_columns(fac), reach)), "nearest"))
        rest = staging.persisted(rest.join(found[-1], ["lat", "lon"], "left_anti"), "places")
        if rest.isEmpty():
            break
    else:
        found.append(best(_far_pairs(rest, fac)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return points.select(key, "lat", "lon").join(out, ["lat", "lon"], "left").select(key, "ref", "distance_m")


def _cell(lat: str, lon: str) -> Column:
    """Number of the whole degree cell."""
    row = F.least(F.floor(F.col(lat)) + 90, F.lit(179).cast("long"))
    return row * 360 + F.floor(F.pmod(F.col(lon) + 180.0, F.lit(360.0)))


def _far_pairs(places: DataFrame, facilities: DataFrame) -> DataFrame:
    """places with the facilities, and their distance, of all cells that may hold the nearest one."""
    spark = places.sparkSession
    held = facility_columns(facilities).withColumn("_cell", _cell("r_lat", "r_lon"))
    full = spark.sparkContext.broadcast(held.select("_cell").distinct().toArrow().column(0).to_numpy())  # 64,800 numbers at most
    mine = places.withColumn("_at", _cell("lat", "lon"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = full.value
        la, lo = np.radians(other // 360 - 89.5), np.radians(other % 360 - 179.5)
        reach = math.radians(math.sqrt(0.5)) * 1.001  # from the middle of a cell to its farthest corner, at most
        for batch in batches:
            for at in batch.column(0).to_numpy():
                p, q = math.radians(at // 360 - 89.5), math.radians(at % 360 - 179.5)
                h = np.sin((la - p) / 2) ** 2 + math.cos(p) * np.cos(la) * np.sin((lo - q) / 2) ** 2
                d = 2 * np.arcsin(np.sqrt(np.minimum(h, 1)))
                near = other[d - 2 * reach <= d.min(initial=np.inf) + 2 * reach]
                yield pa.record_batch([pa.array(np.full(len(near), at)), pa.array(near)], ["_at", "_cell"])

    pairs = mine.select("_at").distinct().mapInArrow(run, "_at long, _cell long")
    joined = mine.join(pairs, "_at").join(held, "_cell").drop("_at", "_cell")
    return joined.withColumn("distance_m", geo.haversine_m("lat", "lon", "r_lat", "r_lon"))


def containing(points: DataFrame, areas: DataFrame, inside: Column | None = None) -> DataFrame:
    """points (lon, lat, ...) with every area (rings, xmin, ymin, xmax, ymax, ...) that holds them.

    Areas are listed under each whole degree cell of their box, so this is an equi join on cells; the box and the ray
    test refine it.
    """
    cells = lambda lo, hi: F.sequence(F.floor(lo), F.floor(hi))
    listed = areas.withColumn("_cx", F.explode(cells("xmin", "xmax"))).withColumn("_cy", F.explode(cells("ymin", "ymax")))
    box = F.col("lon").between(F.col("xmin"), F.col("xmax")) & F.col("lat").between(F.col("ymin"), F.col("ymax"))
    test = inside if inside is not None else geo.in_polygon(F.col("lon"), F.col("lat"), F.col("rings"))
    return points.withColumns({"_cx": F.floor("lon"), "_cy": F.floor("lat")}).join(listed, ["_cx", "_cy"]).filter(box & test).drop("_cx", "_cy")


def first_area(points: DataFrame, areas: DataFrame, key: str, inside: Column | None = None) -> DataFrame:
    """points with the columns area_id and area_name of the containing area with the lowest id, null outside all."""
    hit = containing(points.select(key, "lat", "lon"), areas, inside).groupBy(key).agg(F.min(F.struct("area_id", "area_name")).alias("m"))
    return points.join(hit, key, "left").withColumns({"area_id": F.col("m.area_id"), "area_name": F.col("m.area_name")}).drop("m")
