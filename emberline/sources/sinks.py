"""Writers: atomic snapshots, exports and label files with manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans import serving


def publish(df: DataFrame, root: str, version: str) -> str:
    """Writes a version folder, then a commit row that names it: readers see the old version or the new one."""
    path = f"{root}/{version}"
    df.write.mode("overwrite").parquet(f"{path}/data")
    rows = df.sparkSession.read.parquet(f"{path}/data").count()
    df.sparkSession.createDataFrame([(version, rows)], "version string, n long").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{root}/commits")
    return path


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The data of the latest committed version."""
    try:
        commits = spark.read.schema("version string, n long, at timestamp").json(f"{root}/commits")
        last = commits.orderBy(F.desc("at"), F.desc("version")).limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return spark.read.parquet(f"{root}/{last[0]['version']}/data") if last else None


def insert_new(df: DataFrame, path: str, key: str) -> dict[str, int]:
    """Appends the rows whose key the table lacks."""
    spark = df.sparkSession
    try:
        fresh = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = df
    fresh = fresh.dropDuplicates([key])
    before, total = df.count(), fresh.count()
    fresh.write.mode("append").parquet(path)
    return {"offered": before, "inserted": total}


def write_csv(df: DataFrame, path: str, order: str) -> None:
    serving.csv_export(df).orderBy(order).write.mode("overwrite").csv(path, header=True)


def write_geojson(df: DataFrame, path: str, properties: list[str]) -> None:
    """One feature per line."""
    serving.geojson(df, properties).write.mode("overwrite").text(path)


def validated(features: DataFrame, required: list[str]) -> DataFrame:
    """Report over a column value of feature texts: totals, wrong types, missing geometry, ids and properties."""
    f = features.select(F.from_json("value", "type string, geometry struct<type:string,coordinates:array<double>>, properties map<string,string>").alias("f")).select("f.*")
    checks = [F.count_if(F.try_element_at("properties", F.lit(p)).isNull()).alias(f"missing_{p}") for p in required]
    return f.agg(F.count("*").alias("features"), F.count_if(~F.col("type").eqNullSafe("Feature")).alias("wrong_type"), F.count_if(F.col("geometry").isNull()).alias("no_geometry"), *checks)


def manifest(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Counts by label and split, and one digest of all rows that does not depend on their order."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    counts = df.groupBy(label).pivot(split, ["train", "test", "unused"]).count().fillna(0)
    digest = df.select(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum("h").cast("string")), 256).alias("sha256"))
    return counts.join(F.broadcast(digest))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """output (folder below path), file and sha256 of every data file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("output"), F.element_at(parts, -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def write_labels(df: DataFrame, path: str) -> None:
    """Labels as Parquet and as packed CSV below path, and a manifest with the digest of every file beside them."""
    df.write.mode("overwrite").parquet(f"{path}/files/parquet")
    df.write.mode("overwrite").option("compression", "gzip").csv(f"{path}/files/csv", header=True)
    file_digests(df.sparkSession, f"{path}/files").write.mode("overwrite").json(f"{path}/manifest")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """output, file and state of written labels against their manifest: ok, altered, missing or unlisted."""
    listed = spark.read.schema("output string, file string, sha256 string").json(f"{path}/manifest").withColumnRenamed("sha256", "_listed")
    both = listed.join(file_digests(spark, f"{path}/files"), ["output", "file"], "full_outer")
    state = F.when(F.col("_listed").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("_listed"), "ok").otherwise("altered")
    return both.select("output", "file", state.alias("state"))
