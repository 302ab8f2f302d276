"""Satellite detection files: text scans, archives, and land cover."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import geo, ids

CSV_SCHEMA = "latitude double, longitude double, bright_ti4 double, scan double, track double, acq_date string, acq_time string, satellite string, confidence string, version string, bright_ti5 double, frp string, daynight string"
#: West, south, east and north of the region of interest.
REGION = (67.0, 5.0, 99.0, 38.0)


class UnexpectedPayload(ValueError):
    """The file is no detection table."""


def confidence(c: Column, default: str | None = "nominal") -> Column:
    short = F.lower(c)
    known = F.when(short.isin("l", "low"), "low").when(short.isin("n", "nominal"), "nominal").when(short.isin("h", "high"), "high")
    return F.coalesce(known, F.lit(default)) if default else known


def normalised(raw: DataFrame, product: str, live: bool = True) -> DataFrame:
    """Fixed schema with UTC time and content id; exact repeats dropped. The archive keeps missing day/night flags."""
    time = F.lpad("acq_time", 4, "0")
    acq = F.try_to_timestamp(F.concat("acq_date", F.lit(" "), F.substring(time, 1, 2), F.lit(":"), F.substring(time, 3, 2)), F.lit("yyyy-MM-dd HH:mm"))
    day = F.substring(F.upper("daynight"), 1, 1)
    d = raw.withColumns({
        "acq": acq, "confidence": confidence(F.col("confidence")), "frp": F.coalesce(F.col("frp").try_cast("double"), F.lit(0.0)), "instrument": F.lit(product),
        "daynight": F.coalesce(day, F.lit("D")) if live else day, "lat": F.col("latitude").cast("double"), "lon": F.col("longitude").cast("double"),
    })
    d = d.withColumn("detection_id", ids.detection_id(F.lit(product), F.col("lat"), F.col("lon"), F.col("acq")))
    keep = ["detection_id", "lat", "lon", "acq", "frp", "bright_ti4", "bright_ti5", "scan", "track", "satellite", "confidence", "daynight", "instrument", "version"]
    return d.select(*keep).dropDuplicates(["detection_id"])


def read_csv(spark: SparkSession, path: str, product: str, live: bool = True) -> DataFrame:
    """One product's file or folder. Columns go by the header of each file, whatever their order. A payload whose lines
    hold no header, such as an error page, is refused, and with it the product."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    headed = F.when(F.array_contains(F.split(F.lower("line"), r'"?,"?'), "latitude"), F.col("line"))
    files = lines.groupBy("file").agg(F.first(headed, ignorenulls=True).alias("head")).groupBy("head").agg(F.collect_list("file").alias("files")).collect()
    if not files or any(r["head"] is None for r in files):
        raise UnexpectedPayload(f"{product}: no header")
    kinds = dict(f.strip().split(" ") for f in CSV_SCHEMA.split(","))
    parts = []
    for r in files:  # a few headers, each with its files
        names = [n.strip().strip('"').lower() for n in r["head"].split(",")]
        raw = spark.read.csv(r["files"], header=True, schema=", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names), mode="PERMISSIVE")
        parts.append(raw.select(*[(F.col(n) if n in names else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()]))
    return normalised(reduce(DataFrame.unionByName, parts), product, live)


def read_products(spark: SparkSession, paths: dict[str, str], region: Sequence[float] = REGION) -> tuple[DataFrame, list[str]]:
    """All products that can be read, inside the region, and what went wrong with the others. None at all is an error."""
    found, errors = [], []
    for product, path in paths.items():
        try:
            found.append(read_csv(spark, path, product))
        except Exception as e:  # one failed product must not fail the scan
            errors.append(f"{product}: {type(e).__name__}")
    if not found:
        raise UnexpectedPayload("; ".join(errors) or "no products")
    w, s, e, n = region
    return reduce(DataFrame.unionByName, found).filter(geo.in_box("lat", "lon", s, w, n, e)), errors


def write_archive(det: DataFrame, path: str) -> None:
    """Appends to the archive, by satellite family and day; days that are there already are left alone."""
    d = det.withColumns({"family": F.get(F.split("instrument", "_"), F.lit(1)), "acq_date": F.to_date("acq")})
    try:
        have = det.sparkSession.read.parquet(path).select("family", "acq_date").distinct()
        d = d.join(have, ["family", "acq_date"], "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    d.write.mode("append").partitionBy("family", "acq_date").parquet(path)


def read_archive(spark: SparkSession, paths: Sequence[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """Archive rows of the days asked for (pruned by partition), one per place, time and instrument."""
    d = spark.read.parquet(*paths)
    if first:
        d = d.filter(F.col("acq_date") >= F.lit(first).cast("date"))
    if last:
        d = d.filter(F.col("acq_date") <= F.lit(last).cast("date"))
    return d.dropDuplicates(["lat", "lon", "acq", "instrument"]).fillna({"confidence": "nominal"})


def around(det: DataFrame, lat: float, lon: float, degrees: float, first: str, last: str) -> DataFrame:
    day = F.to_date("acq")
    return det.filter(geo.in_box("lat", "lon", lat - degrees, lon - degrees, lat + degrees, lon + degrees) & day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))).dropDuplicates(["lat", "lon", "acq", "instrument"])


# ---- land cover
#: Raster codes of the land-cover product by group.
GROUPS = {"tree": [10], "woody": [10, 20, 95], "crop": [40], "vegetation": [10, 20, 30, 90, 95, 100], "built": [50], "bare": [60], "water": [80]}
NAMES = {10: "tree", 20: "shrub", 30: "grass", 40: "cropland", 50: "built", 60: "bare", 70: "snow", 80: "water", 90: "wetland", 95: "mangrove", 100: "moss"}


def cover_cell(lat: str, lon: str, degrees: float = 0.002) -> Column:
    """Key of the cache cell of a point."""
    part = lambda c: F.format_string("%.3f", F.bround(F.col(c) / degrees) * degrees)
    return F.concat_ws(",", part(lat), part(lon))


def cover_fractions(chips: DataFrame, codes: str = "codes") -> DataFrame:
    """Shares of each group and the dominant name from an array of codes (0: no data); null where all is missing."""
    ok = F.filter(codes, lambda v: v > 0)
    share = lambda members: F.when(F.size(ok) > 0, F.size(F.filter(ok, lambda v: v.isin(members))) / F.size(ok))
    counted = F.transform(F.array_distinct(ok), lambda v: F.struct((-F.size(F.filter(ok, lambda x: x == v))).alias("n"), v.alias("v")))
    names = F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, v)])
    return chips.withColumns({f"lc_{g}": share(m) for g, m in GROUPS.items()} | {"lc_dominant": F.try_element_at(names, F.array_min(counted)["v"])})


def with_cover(points: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with cached land cover, and the cells that the cache lacks."""
    d = points.withColumn("cell", cover_cell("lat", "lon"))
    return d.join(cache, "cell", "left"), d.select("cell").distinct().join(cache.select("cell"), "cell", "left_anti")


def prefetch_points(*frames: DataFrame) -> DataFrame:
    """Distinct cells of facilities, current sources and recent detections."""
    return reduce(DataFrame.union, [f.select(cover_cell("lat", "lon").alias("cell")) for f in frames]).distinct()
