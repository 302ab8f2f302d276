"""Read side: listings, pages, statistics, dashboards and exports as functions that return DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.functions import geo, text
from emberline.operators import ordering
from emberline.operators.heat_sources import CLASSES


@dataclass(frozen=True)
class SiteFilters:
    """Equality is case-insensitive; search is containment in any of the searched columns."""

    equal: dict[str, str] = field(default_factory=dict)
    search: str | None = None
    bbox: tuple[float, float, float, float] | None = None
    active_only: bool = True


SEARCHED = ["name", "industry_type", "state", "district", "evidence_level"]


def sites(df: DataFrame, f: SiteFilters = SiteFilters()) -> DataFrame:
    test = F.col("is_active") if f.active_only else F.lit(True)
    for c, v in f.equal.items():
        test = test & (F.lower(c) == v.lower())
    if f.search:
        test = test & text.contains_ci(SEARCHED, f.search)
    if f.bbox:
        test = test & geo.in_box("lat", "lon", *f.bbox)
    return df.filter(test)


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """A stable page: order must end in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def keyset_page(df: DataFrame, key: str, before: int | None, limit: int, prefix: tuple[str, str] | None = None) -> DataFrame:
    """Newest first, below a key; prefix filters a column by its beginning."""
    d = df if before is None else df.filter(F.col(key) < before)
    d = d.filter(F.col(prefix[0]).startswith(prefix[1])) if prefix else d
    return d.orderBy(F.desc(key)).limit(limit)


def statistics(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts by each dimension in one pass: dimension, value and n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("Unassigned")).alias("value")) for d in dimensions]))
    return df.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"), F.countDistinct("state").alias("states"), F.countDistinct("district").alias("districts"), F.count_if(F.col("evidence_level") == "high").alias("high_evidence"))


def filter_options(df: DataFrame) -> DataFrame:
    return df.filter("is_active").select("district", "state").distinct()


@dataclass(frozen=True)
class ThermalFilters:
    classes: tuple[str, ...] = ()
    state: str | None = None
    min_frp: float | None = None
    alerts_only: bool = False
    kind: str | None = None
    hours: float | None = None
    bbox: tuple[float, float, float, float] | None = None


def thermal(df: DataFrame, f: ThermalFilters) -> DataFrame:
    """hours counts back from the newest source, not from the clock."""
    if unknown := set(f.classes) - set(CLASSES):
        raise ValueError(f"unknown classes: {sorted(unknown)}")
    test = F.lit(True)
    if f.classes:
        test = test & F.col("thermal_class").isin(*f.classes)
    if f.state:
        test = test & (F.lower("state") == f.state.lower())
    if f.min_frp is not None:
        test = test & (F.col("frp_max") >= f.min_frp)
    if f.alerts_only:
        test = test & F.col("alert_level").isNotNull()
    if f.kind:
        test = test & (F.col("site_kind") == f.kind)
    if f.bbox:
        test = test & geo.in_box("lat", "lon", *f.bbox)
    out = df.filter(test)
    if f.hours is not None:
        newest = F.broadcast(df.agg(F.max("last_seen").alias("_newest")))
        out = out.join(newest, F.col("last_seen") >= F.col("_newest") - F.expr(f"INTERVAL '{int(f.hours)}' HOUR")).drop("_newest")
    return out


def alert_rank() -> Column:
    return F.when(F.col("alert_level") == "critical", 3).when(F.col("alert_level") == "high", 2).when(F.col("alert_level") == "watch", 1).otherwise(0)


def thermal_page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return page(df, [alert_rank().desc(), F.desc("frp_total"), F.col("cluster")], limit, offset)


def facilities(df: DataFrame, kinds: Sequence[str] = (), source: str | None = None, bbox=None, limit: int | None = None) -> DataFrame:
    d = df.filter(F.col("kind").isin(*kinds)) if kinds else df
    d = d.filter(F.array_contains(F.split("sources", ","), source)) if source else d
    d = d.filter(geo.in_box("lat", "lon", *bbox)) if bbox else d
    return d if limit is None else d.orderBy(F.size(F.split("sources", ",")).desc(), "ref").limit(limit)


def search_facilities(df: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Every word of the query in name or kind; names that begin with it first, then short ones."""
    words = query.lower().split()
    hay = F.lower(F.concat_ws(" ", "name", F.replace("kind", F.lit("_"), F.lit(" "))))
    d = df.filter(F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(hay, w))) if words else df.limit(0)
    return d.orderBy((~F.lower("name").startswith(query.lower())).cast("int"), F.length("name"), "ref").limit(limit)


def thermal_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("thermal_class").agg(F.count("*").alias("n"), F.round(F.sum("frp_total"), 1).alias("frp_total"), F.sum("n_detections").alias("n_detections"))


def top_states(df: DataFrame, k: int) -> DataFrame:
    d = df.groupBy(F.coalesce("state", F.lit("Unassigned")).alias("state")).agg(F.count("*").alias("n"), F.count_if(F.col("evidence_level") == "high").alias("n_high"))
    return d.orderBy(F.desc("n"), "state").limit(k)


def daily_counts(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows per UTC day over the last days before the newest one."""
    newest = F.broadcast(df.agg(F.max(F.to_date(ts)).alias("_d")))
    return df.join(newest, F.to_date(ts) > F.date_sub("_d", days)).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def downsampled(df: DataFrame, order: str, points: int) -> DataFrame:
    """At most so many rows of a series, evenly spread, first and last included. Ranks come from ranges of the order."""
    d = ordering.ranked(df, [order], "_i").join(F.broadcast(df.agg(F.count("*").alias("_n"))))
    step = F.greatest(F.col("_n") - 1, F.lit(1)) / F.lit(points - 1)
    wanted = F.round(F.round(F.col("_i") / step) * step)
    return d.filter((F.col("_n") <= points) | (wanted == F.col("_i"))).drop("_n", "_i")


def density(df: DataFrame, size: float) -> DataFrame:
    """Cells of size degrees with counts, powers, the dominant class and an opacity."""
    cell = {"cell_lat": F.floor(F.col("lat") / size) * size, "cell_lon": F.floor(F.col("lon") / size) * size}
    by_class = df.withColumns(cell).groupBy("cell_lat", "cell_lon", "thermal_class").agg(F.count("*").alias("n"), F.max("frp_max").alias("frp_max"), F.sum("frp_total").alias("frp_total"))
    out = by_class.groupBy("cell_lat", "cell_lon").agg(
        F.sum("n").alias("n"), F.max("frp_max").alias("frp_max"), F.sum("frp_total").alias("frp_total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("thermal_class", "n")))).alias("classes"), F.min(F.struct((-F.col("n")).alias("n"), "thermal_class"))["thermal_class"].alias("dominant")
    )
    most = F.broadcast(out.agg(F.max("n").alias("_most")))
    return out.join(most).withColumn("opacity", F.sqrt(F.col("n") / F.col("_most"))).drop("_most")


def class_shares(df: DataFrame, name: str = "thermal_class") -> DataFrame:
    """Share of each class and the running sum in class order, for stacked bars."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(CLASSES) for x in (c, i)])
    d = df.groupBy(name).agg(F.count("*").alias("n")).withColumn("_o", F.try_element_at(order, F.col(name)))
    everything = W.partitionBy()
    running = W.orderBy("_o").rowsBetween(W.unboundedPreceding, 0)
    share = F.col("n") / F.sum("n").over(everything)
    return d.withColumn("share", share).withColumn("running", F.sum("share").over(running)).drop("_o")


def column_height(frp: Column, scale: float = 1.0) -> Column:
    return F.round((800 + F.sqrt(F.greatest(frp, F.lit(0.0))) * 1800) * scale)


def source_detail(source: DataFrame, detections: DataFrame, key: str = "cluster") -> DataFrame:
    """One row per source with its detections as an array in time order."""
    d = detections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("acq", "detection_id", "frp"))).alias("detections"))
    return source.join(d, key, "left")


def model_opinion(model: Column, rules: Column) -> Column:
    """How a learned class compares with that of the rules, which alone know fires."""
    return F.when(model.isNull(), "none").when(rules == "industrial_fire_candidate", "rules_only").when(model == rules, "agrees").otherwise("differs")


def freshness(df: DataFrame, now: Column) -> DataFrame:
    """State of each source: configured, initialised, running, last_success, interval_s, failing."""
    age = F.unix_timestamp(now) - F.unix_timestamp("last_success")
    state = (
        F.when(~F.col("configured"), "not_configured")
        .when(~F.col("initialised"), "awaiting_setup")
        .when(F.col("running"), "syncing")
        .when(F.col("last_success").isNull() | (age > 12 * F.col("interval_s")), "offline")
        .when(F.col("failing") | (age > 3 * F.col("interval_s")), "delayed")
        .otherwise("live")
    )
    return df.withColumn("state", state)


def worst_state(df: DataFrame) -> DataFrame:
    order = ["live", "syncing", "delayed", "awaiting_setup", "offline"]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("state"))
    return df.filter("state <> 'not_configured'").agg(F.max_by("state", rank).alias("overall"))


def geojson(df: DataFrame, properties: Sequence[str]) -> DataFrame:
    """One feature per row as JSON text; null and NaN properties are left out."""
    kinds = dict(df.dtypes)
    props = F.struct(*[(F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in properties])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("value"))


def csv_export(df: DataFrame) -> DataFrame:
    """String columns safe for spreadsheets."""
    return df.select(*[text.csv_safe(F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes])
