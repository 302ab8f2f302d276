"""Registry files by suffix, and the union of several sources of which some may be missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import quality

SUMMARY = "source string, status string, accepted long, rejected long"


class UnsupportedFile(ValueError):
    """No reader for this kind of file: geo-packages, shape files and workbooks are converted before."""


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A file, or a folder of them, by the suffix of its name. Points of a feature collection become two columns."""
    suffix = path.rstrip("/").lower().rsplit(".", 1)[-1]
    if suffix in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="," if suffix == "csv" else "\t")
    if suffix == "json":  # an object a line, or one document
        first = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
        return spark.read.json(path, multiLine=not first or not first[0][0].strip().endswith("}"))
    if suffix == "geojson":
        f = spark.read.json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.*")
        return f.select("properties.*", F.col("geometry.coordinates")[0].alias("longitude"), F.col("geometry.coordinates")[1].alias("latitude"))
    raise UnsupportedFile(path)


def ingest(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame | None, DataFrame]:
    """Accepted records of all sources that can be read, columns by name, and one summary row for each source. A source
    that cannot be read is reported and stops nothing."""
    found, rows = [], []
    for source, path in paths.items():
        try:
            ok, bad = quality.government_records(read_table(spark, path), source)
            rows.append((source, "read", ok.count(), bad.count()))
            found.append(ok)
        except Exception as e:  # an unavailable source must not fail the others
            rows.append((source, f"unavailable: {type(e).__name__}", 0, 0))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None
    return union, spark.createDataFrame(rows, SUMMARY)
