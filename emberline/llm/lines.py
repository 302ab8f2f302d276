"""Removal of lines that spread over many sites. DataFrame functions only.

A line is a part of the text between line feeds, without the blanks at its ends; blank lines are never removed. Lines
are known by two independent 64-bit hashes. A HyperLogLog sketch of the sites is kept for each of them and merged by the
aggregation. A line whose estimate is clear of the threshold is decided by it; lines near the threshold get an exact
distinct count. A spread line leaves every document that holds it, whatever its share of the text.

Null text stays null and an empty one empty; a null site counts as one site of its own. Repeated rows are treated alike,
and rows that share a key each keep their own text. Very long texts are split in place; only the hashes of their lines
are shuffled. An empty table gives no rows. Other columns pass through, whatever their names; only columns named
__n_lines and __n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stage

#: Sketches of 2^12 registers: a relative standard error of about 1.6 %.
LOG_REGISTERS = 12
#: Width of the band around the threshold, relative: more than four standard errors, and one site at least.
BAND = 0.07
_LINE = ["hash", "check"]


def _parts(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _lines(df: DataFrame, *keep: Column) -> DataFrame:
    """A row for each line that is not blank: keep, its place and its two hashes. df has a column text."""
    one = df.select(*keep, F.posexplode(F.transform(_parts(F.col("text")), lambda x: F.trim(x))).alias("place", "line")).filter("line != ''")
    return one.withColumns({"hash": F.xxhash64("line"), "check": F.xxhash64(F.lit(1), "line")}).drop("line")


def spread_lines(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = 10) -> DataFrame:
    """hash and check of the lines that occur on min_sites distinct sites or more."""
    rows = df.select(F.col(text).alias("text"), F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"))
    lines = _lines(rows, F.col("site")).drop("place")
    estimate = lines.groupBy(*_LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("sites"))
    slack = max(1.0, BAND * min_sites)
    estimate = stage.persisted(estimate.filter(F.col("sites") >= min_sites - slack), "line-estimates")
    sure = estimate.filter(F.col("sites") > min_sites + slack).select(*_LINE)
    near = estimate.filter(F.col("sites") <= min_sites + slack).select(*_LINE)
    exact = lines.join(near, _LINE, "left_semi").distinct().groupBy(*_LINE).count().filter(F.col("count") >= min_sites).select(*_LINE)
    return sure.unionByName(exact)


def drop_spread_lines(df: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 10) -> DataFrame:
    """df with the text rewritten, and the columns __n_lines and __n_removed."""
    bad = stage.persisted(spread_lines(df, text, site, min_sites), "spread-lines")
    names = [c for c in df.columns if c not in ("__n_lines", "__n_removed")]
    # the columns of df stand in a struct, out of the way of those that are made here
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("mark", F.xxhash64("text"))
    hits = _lines(rows, F.col("id"), F.col("mark")).join(bad, _LINE, "left_semi").groupBy("id", "mark").agg(F.collect_set("place").alias("bad"))
    hits = hits.select(F.col("id").alias("hit_id"), F.col("mark").alias("hit_mark"), "bad")
    joined = rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & F.col("mark").eqNullSafe(F.col("hit_mark")), "left")
    parts = _parts(F.col("text"))
    good = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("bad"))
    kept = F.array_join(F.transform(good, lambda i: F.get(parts, i)), "\n")
    out = joined.withColumn("kept", F.when(F.col("bad").isNotNull(), kept).otherwise(F.col("text")))
    return out.select(
        *[F.col("kept").alias(c) if c == text else F.col("doc")[c].alias(c) for c in names],
        F.coalesce(F.size(parts), F.lit(0)).alias("__n_lines"),
        F.coalesce(F.size("bad"), F.lit(0)).alias("__n_removed"),
    )


def with_length(df: DataFrame, text: str, length: str) -> DataFrame:
    """df with the column named length, where it has one, set to the characters of the text."""
    return df.withColumn(length, F.length(text).cast(dict(df.dtypes)[length])) if length in df.columns else df
