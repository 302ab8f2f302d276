"""Duplicate removal inside one registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline import staging
from emberline.functions import text
from emberline.operators import graph, spatial


def keep_first(df: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the removed ones with the size of their group."""
    by = W.partitionBy(*keys)
    marked = df.withColumns({"_rn": F.row_number().over(by.orderBy(order)), "group_size": F.count("*").over(by)})
    return marked.filter("_rn = 1").drop("_rn", "group_size"), marked.filter("_rn > 1").drop("_rn")


def two_pass(df: DataFrame, source: str, source_id: str, order: str, digits: int = 6) -> DataFrame:
    """By source and id where there is an id, else by rounded place."""
    place = F.concat_ws("|", F.lit("at"), F.round("lat", digits).cast("string"), F.round("lon", digits).cast("string"))
    key = F.when(F.col(source_id).isNotNull(), F.concat_ws("|", F.lit("id"), F.col(source), F.col(source_id).cast("string"))).otherwise(place)
    marked = df.withColumn("_k", key)
    return marked.withColumn("_rn", F.row_number().over(W.partitionBy("_k").orderBy(order))).filter("_rn = 1").drop("_rn", "_k")


def by_place(df: DataFrame, order: str, group: str | None = None, digits: int = 6) -> DataFrame:
    keys = [F.round("lat", digits), F.round("lon", digits), *([F.col(group)] if group else [])]
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_rn = 1").drop("_rn")


def _close_pairs(df: DataFrame, key: str, reach_m: float, columns: list[str]) -> DataFrame:
    left = df.select(key, "lat", "lon", *columns)
    right = df.select(*[F.col(c).alias(f"r_{c}") for c in [key, "lat", "lon", *columns]])
    return spatial.pairs_within(left, right, reach_m).filter(F.col(key) < F.col(f"r_{key}"))


def _agree(a: Column, b: Column) -> Column:
    """Equal, or one of them missing."""
    return a.isNull() | b.isNull() | (F.lower(a) == F.lower(b))


def near_duplicates(df: DataFrame, key: str, reach_m: float = 100.0, remove: float = 90.0, flag: float = 70.0, similarity=text.token_set_ratio) -> DataFrame:
    """df with duplicate_of and flagged. In key order a kept row removes later rows near it with a like name; rows of
    middling likeness are flagged. Rows need the same state, district and industry, where both have one.

    A pair of middling likeness counts where its first row is kept and no row before that one has removed the second.
    """
    numbers = text.kinds(df.select("name"))
    if numbers is not None:
        return _near_duplicate_kinds(df, key, reach_m, remove, flag, text.kind_scores(numbers, similarity, flag), numbers)
    pairs = _close_pairs(df, key, reach_m, ["name", "industry", "state", "district"])
    pairs = pairs.filter(_fits()).withColumn("score", similarity("name", "r_name")).filter(F.col("score") >= flag).select(F.col(key).alias("a"), F.col(f"r_{key}").alias("b"), "score")
    pairs = staging.persisted(pairs, "like-pairs")
    gone = staging.persisted(graph.first_covering(pairs.filter(F.col("score") >= remove)), "removed")
    soft = pairs.filter(F.col("score") < remove).join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b"), "anchor"), "b", "left").filter("anchor is null or anchor > a")
    return _marked(df, key, gone, soft.select(F.explode(F.array("a", "b")).alias("node")))


def _fits() -> Column:
    return _agree(F.col("industry"), F.col("r_industry")) & _agree(F.col("state"), F.col("r_state")) & _agree(F.col("district"), F.col("r_district"))


def _marked(df: DataFrame, key: str, gone: DataFrame, flagged: DataFrame) -> DataFrame:
    flags = flagged.select(F.col("node").alias(key)).distinct().withColumn("_flag", F.lit(True))
    out = df.join(gone.select(F.col("node").alias(key), F.col("anchor").alias("duplicate_of")), key, "left").join(flags, key, "left")
    return out.withColumn("flagged", F.coalesce("_flag", F.lit(False))).drop("_flag")


def _near_duplicate_kinds(df: DataFrame, key: str, reach_m: float, remove: float, flag: float, scores: DataFrame, numbers: DataFrame) -> DataFrame:
    """near_duplicates for names of few kinds. Pairs are joined by place and kind, first those that remove, then those
    of middling likeness of the kept rows alone, which are few.

    Rows alike in place, name, industry, state and district stand and fall together where their name is like itself:
    the first removes the others, or is removed and its anchor removes them too. Only the first takes part; another one
    is flagged by the rows before the first that flag it, as no kept row between them counts.
    """
    fields = ["lat", "lon", "n", "industry", "state", "district"]
    rows = text.with_kind(df.select(key, "lat", "lon", "name", "industry", "state", "district"), "name", numbers, "n").drop("name").filter("n is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").distinct()
    same = scores.filter((F.col("a") == F.col("b")) & (F.col("score") >= remove)).select(F.col("a").alias("n"), F.lit(True).alias("_same"))
    once = df.groupBy(key).count().filter("count = 1").select(key, F.lit(True).alias("_once"))  # a key of several records is none of a group
    rows = rows.join(F.broadcast(same), "n", "left").join(once, key, "left").withColumn("_one", F.coalesce(F.col("_same") & F.col("_once"), F.lit(False))).drop("_same", "_once")
    first = rows.filter("_one").groupBy(*[F.col(c).alias(f"g_{c}") for c in fields]).agg(F.min(key).alias("_first"))
    alike = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in fields], F.col("_one"))
    rows = staging.persisted(rows.join(first, alike, "left").select(key, *fields, F.coalesce("_first", key).alias("_first")), "records")
    nodes, others = rows.filter(F.col(key) == F.col("_first")).drop("_first"), rows.filter(F.col(key) > F.col("_first")).select(F.col(key).alias("node"), "_first")
    right = nodes.select(*[F.col(c).alias(f"r_{c}") for c in nodes.columns])
    near = staging.persisted(spatial.places_within(nodes, right, reach_m).drop("distance_m"), "near-places")

    def like(left: DataFrame, these: DataFrame) -> DataFrame:
        these = these.select(F.col("a").alias("n"), F.col("b").alias("r_n"))
        found = left.join(near, ["lat", "lon"]).join(F.broadcast(these), "n").join(right, ["r_lat", "r_lon", "r_n"])
        return found.filter((F.col(key) < F.col(f"r_{key}")) & _fits()).select(F.col(key).alias("a"), F.col(f"r_{key}").alias("b"))

    gone = staging.persisted(graph.first_covering(staging.persisted(like(nodes, scores.filter(F.col("score") >= remove)), "removing")), "removed")
    kept = nodes.join(gone.select(F.col("node").alias(key)), key, "left_anti")
    soft = like(kept, scores.filter(F.col("score") < remove)).join(gone.select(F.col("node").alias("b"), "anchor"), "b", "left").filter("anchor is null or anchor > a").select("a", "b")
    soft = staging.persisted(soft.distinct(), "middling")
    flagged = soft.select(F.col("a").alias("node")).unionByName(soft.select(F.col("b").alias("node")))
    flagged = flagged.unionByName(others.join(soft.select(F.col("b").alias("_first")).distinct(), "_first", "left_semi").select("node"))
    removed = others.join(gone.select(F.col("node").alias("_first"), "anchor"), "_first", "left").select("node", F.coalesce("anchor", "_first").alias("anchor"))
    return _marked(df, key, gone.unionByName(removed), flagged)


def probable_groups(df: DataFrame, key: str, reach_m: float = 50.0, ratio: float = 88.0) -> DataFrame:
    """df with group: the smallest key of the component of near rows with like names and fitting industries."""
    pairs = _close_pairs(df, key, reach_m, ["name", "industry"]).filter(_agree(F.col("industry"), F.col("r_industry")))
    edges = pairs.withColumn("score", text.ratio("name", "r_name")).filter(F.col("score") >= ratio).select(F.col(key).alias("a"), F.col(f"r_{key}").alias("b"))
    return graph.with_components(df, edges, key, "group")


def trigram_pairs(df: DataFrame, key: str, reach_m: float, least: float) -> DataFrame:
    """Pairs a < b within reach whose names share enough trigrams; no Python in the plan. Names of few kinds are compared
    once for each pair of kinds."""
    numbers = text.kinds(df.select("name"))
    found = lambda d: d.select(F.col(key).alias("a"), F.col(f"r_{key}").alias("b"), "distance_m", "similarity")
    if numbers is None:
        pairs = _close_pairs(df, key, reach_m, ["name"]).withColumn("similarity", text.trigram_similarity(F.col("name"), F.col("r_name")))
        return found(pairs.filter(F.col("similarity") >= least))
    left = text.with_kind(df.select(key, "lat", "lon", "name"), "name", numbers, "n").drop("name")
    right = left.select(*[F.col(c).alias(f"r_{c}") for c in left.columns])
    like = text.kind_scores(numbers, text.trigram_similarity, least).select("pair", F.col("score").alias("similarity"))
    pairs = spatial.pairs_by_place(left, right, reach_m).filter(F.col(key) < F.col(f"r_{key}"))
    return found(pairs.withColumn("pair", text.kind_pair("n", "r_n")).join(F.broadcast(like), "pair"))
