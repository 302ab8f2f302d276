"""Data-quality counts, taxonomy lookup, and schema-on-read cleaning of government files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import text


def report(df: DataFrame, keys: list[str], lat: str = "lat", lon: str = "lon", box=(6.0, 67.0, 38.0, 98.0)) -> DataFrame:
    """One row of counts, in one pass over df and one over its keys."""
    place = F.col(lat).isNull() | F.col(lon).isNull()
    valid = F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    inside = F.col(lat).between(box[0], box[2]) & F.col(lon).between(box[1], box[3])
    counts = df.agg(F.count("*").alias("total"), F.count_if(place).alias("null_coordinates"), F.count_if(~place & ~valid).alias("invalid_coordinates"), F.count_if(valid & ~inside).alias("outside"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns if c not in (lat, lon)])
    groups = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).alias("duplicate_rows"))
    return counts.join(groups)


def match_rate(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of left records with an automatic match, and the unmatched of each side."""
    auto = pairs.filter("match_confidence = 'automatic_match'")
    count = lambda df, c: df.select(F.count("*").alias(c))
    parts = [count(left, "left_total"), count(right, "right_total"), auto.agg(F.countDistinct("left_id").alias("left_matched"), F.countDistinct("right_id").alias("right_matched"))]
    one = reduce(lambda a, b: a.join(b), parts)
    return one.withColumns({"match_rate": F.col("left_matched") / F.greatest("left_total", F.lit(1)), "left_unmatched": F.col("left_total") - F.col("left_matched"), "right_unmatched": F.col("right_total") - F.col("right_matched")})


def classified(df: DataFrame, column: str, aliases: DataFrame, fallback: str) -> DataFrame:
    """df with code: exact alias after collapsing and lower-casing; of aliases given twice the first code by order wins."""
    key = F.lower(text.collapse(F.col("alias")))
    table = aliases.select(key.alias("_a"), "code").groupBy("_a").agg(F.min("code").alias("code"))
    return df.withColumn("_a", F.lower(text.collapse(F.col(column)))).join(table, "_a", "left").withColumn("code", F.coalesce("code", F.lit(fallback))).drop("_a")


#: Names that coordinate columns go by.
LATITUDES, LONGITUDES = ("latitude", "lat", "y", "y_coord"), ("longitude", "lon", "lng", "long", "x", "x_coord")


def standardised(df: DataFrame) -> DataFrame:
    """Columns renamed to their standard form; a name that comes twice gets a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = text.column_name(c)
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def government_records(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Accepted records with lat, lon, source and the raw row as JSON, and rejected ones with the reason."""
    d = standardised(df)
    raw = F.to_json(F.struct(*[F.col(c) for c in d.columns]))
    lat, lon = (next((c for c in names if c in d.columns), None) for names in (LATITUDES, LONGITUDES))
    number = lambda c: F.col(c).try_cast("double") if c else F.lit(None).cast("double")
    d = d.withColumns({"raw_record": raw, "source": F.lit(source), "_lat": number(lat), "_lon": number(lon)})
    reason = F.when(F.col("_lat").isNull() | F.col("_lon").isNull(), "missing coordinates").when(~F.col("_lat").between(-90, 90) | ~F.col("_lon").between(-180, 180), "invalid coordinates")
    d = d.withColumn("reason", reason)
    ok = d.filter("reason is null").drop("reason", *[c for c in (lat, lon) if c in ("lat", "lon")]).withColumnsRenamed({"_lat": "lat", "_lon": "lon"})
    return ok, d.filter("reason is not null").select("source", "raw_record", "reason")


def value_class(c):
    """Missing, unknown and not-applicable tokens of a free classification column."""
    t = F.lower(F.trim(c))
    return F.when(t.isNull() | (t == ""), None).when(t.isin("unknown", "unk", "not known", "?"), "unknown").when(t.isin("n/a", "na", "n.a.", "not applicable", "nil", "-"), "not_applicable").otherwise(F.trim(c))
