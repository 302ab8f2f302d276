"""The 365-day profile of each facility and of each 1 km cell, and how a source compares with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators import detections

WINDOW_DAYS, EXCLUDE_RECENT_DAYS, MIN_STD_MW = 365, 14, 1.0


def window_bounds(det: DataFrame, anchor: str | None = None, window_days: int = WINDOW_DAYS, exclude_days: int = EXCLUDE_RECENT_DAYS) -> DataFrame:
    """One row: first_day and last_day, both inclusive."""
    day = F.lit(anchor).cast("date") if anchor else F.to_date(F.max("acq"))
    last = F.date_sub(day, exclude_days)
    return det.agg(F.date_sub(last, window_days - 1).alias("first_day"), last.alias("last_day"))


def in_window(det: DataFrame, anchor: str | None = None, window_days: int = WINDOW_DAYS, exclude_days: int = EXCLUDE_RECENT_DAYS) -> DataFrame:
    bounds = window_bounds(det, anchor, window_days, exclude_days)
    return det.join(F.broadcast(bounds), F.to_date("acq").between(F.col("first_day"), F.col("last_day")))


def entity_rows(det: DataFrame) -> DataFrame:
    """Each detection once for its facility, where it has one, and once for its cell: one scan, not two."""
    scopes = F.array(F.struct(F.lit("facility").alias("scope"), F.col("facility_id").cast("string").alias("key")), F.struct(F.lit("cell").alias("scope"), F.col("cell_key").alias("key")))
    return det.withColumn("_e", F.explode(scopes)).select("*", "_e.scope", "_e.key").drop("_e").filter("key is not null")


def entity_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scope", "key", "day").agg(F.sum("frp").alias("frp_day"))


def compute(det: DataFrame, anchor: str | None = None, window_days: int = WINDOW_DAYS, exclude_days: int = EXCLUDE_RECENT_DAYS) -> DataFrame:
    """det: detections with facility_id and cell_key. Days without any detection anywhere are not covered."""
    window = in_window(det, anchor, window_days, exclude_days)
    days = window.select(F.to_date("acq").alias("day")).distinct()
    per_month = F.map_from_entries(F.collect_list(F.struct("m", "n")))
    covered = days.groupBy(F.month("day").alias("m")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("covered_days"), per_month.alias("covered_by_month"))
    rows = entity_rows(detections.physical(window))
    stats = rows.groupBy("scope", "key").agg(
        F.count("*").alias("n_detections"),
        F.percentile("frp", F.array(F.lit(0.5), F.lit(0.95))).alias("q"),
        F.avg(detections.night()).alias("night_share"),
    )
    per_day = entity_days(rows).withColumn("m", F.month("day"))
    monthly = per_day.groupBy("scope", "key", "m").agg(F.count("*").alias("n"), F.sum("frp_day").alias("s1"), F.sum(F.col("frp_day") * F.col("frp_day")).alias("s2"))
    daily = monthly.groupBy("scope", "key").agg(F.sum("n").alias("active_days"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), per_month.alias("by_month"))
    mean = F.col("s1") / F.col("covered_days")
    profile = F.transform(
        F.sequence(F.lit(1), F.lit(12)),
        lambda m: F.when(F.try_element_at("covered_by_month", m).isNotNull(), F.round(F.coalesce(F.try_element_at("by_month", m), F.lit(0)) / F.try_element_at("covered_by_month", m), 4)),
    )
    bounds = window_bounds(det, anchor, window_days, exclude_days)
    return stats.join(daily, ["scope", "key"]).join(F.broadcast(covered)).join(F.broadcast(bounds)).select(
        "scope", "key", "active_days", "covered_days", (F.col("active_days") / F.col("covered_days")).alias("active_fraction"), profile.alias("monthly_profile"),
        F.col("q")[0].alias("frp_median"), F.col("q")[1].alias("frp_p95"), "night_share", "n_detections", mean.alias("daily_frp_mean"),
        F.sqrt(F.greatest(F.col("s2") / F.col("covered_days") - mean * mean, F.lit(0.0))).alias("daily_frp_std"), F.col("first_day").alias("window_start"), F.col("last_day").alias("window_end"),
    )


def latest_day(det: DataFrame) -> DataFrame:
    """scope, key, frp_today and frp_today_date: the sum of an entity's latest day."""
    per_day = entity_days(entity_rows(det.withColumn("day", F.to_date("acq"))))
    return per_day.groupBy("scope", "key").agg(F.max_by("frp_day", "day").alias("frp_today"), F.max("day").alias("frp_today_date"))


def modal_cell(det: DataFrame, cluster: str = "cluster") -> DataFrame:
    """The cell with most of a cluster's detections; ties go to the smallest key."""
    counts = det.groupBy(cluster, "cell_key").agg(F.count("*").alias("n"))
    return counts.groupBy(cluster).agg(F.min(F.struct((-F.col("n")).alias("n"), "cell_key"))["cell_key"].alias("cell_key"))


def z_score(today: str, mean: str, std: str):
    return F.bround((F.col(today) - F.coalesce(F.col(mean), F.lit(0.0))) / F.greatest(F.coalesce(F.col(std), F.lit(0.0)), F.lit(MIN_STD_MW)), 2)


def attach(sources: DataFrame, det: DataFrame, profile: DataFrame) -> DataFrame:
    """sources: cluster, site_ref, site_within, cell_key (of the centre). The entity is the facility if the source is
    inside one that has detections, else the cluster's modal cell, else the centre's cell."""
    today = latest_day(det)
    fac = today.filter("scope = 'facility'").select(F.col("key").alias("_fk"), F.col("frp_today").alias("_ft"), F.col("frp_today_date").alias("_fd"))
    cell = today.filter("scope = 'cell'").select(F.col("key").alias("_ck"), F.col("frp_today").alias("_ct"), F.col("frp_today_date").alias("_cd"))
    modal = modal_cell(det).withColumnRenamed("cell_key", "_modal")
    s = sources.join(modal, "cluster", "left").withColumn("_cell", F.coalesce("_modal", "cell_key"))
    s = s.join(fac, (F.col("site_ref").cast("string") == F.col("_fk")) & F.col("site_within"), "left").join(cell, F.col("_cell") == F.col("_ck"), "left")
    at = F.col("_fk").isNotNull()
    s = s.withColumns({
        "baseline_scope": F.when(at, "facility").otherwise("cell"), "baseline_key": F.when(at, F.col("_fk")).otherwise(F.col("_cell")),
        "frp_today": F.when(at, F.col("_ft")).otherwise(F.col("_ct")), "frp_today_date": F.when(at, F.col("_fd")).otherwise(F.col("_cd")),
    })
    p = profile.select(F.col("scope").alias("baseline_scope"), F.col("key").alias("baseline_key"), F.col("active_fraction").alias("baseline_active_fraction"), "daily_frp_mean", "daily_frp_std", F.col("frp_median").alias("baseline_frp_median"), F.col("frp_p95").alias("baseline_frp_p95"), F.col("night_share").alias("baseline_night_share"), F.col("monthly_profile").alias("baseline_monthly"))
    s = s.join(p, ["baseline_scope", "baseline_key"], "left")
    return s.withColumns({
        "baseline_known": F.col("baseline_frp_median").isNotNull(), "baseline_active_fraction": F.coalesce("baseline_active_fraction", F.lit(0.0)),
        "frp_z": F.when(F.col("frp_today").isNotNull(), z_score("frp_today", "daily_frp_mean", "daily_frp_std")),
    }).drop("_modal", "_cell", "_fk", "_ft", "_fd", "_ck", "_ct", "_cd", "daily_frp_mean", "daily_frp_std")


def deviation_label(z: str):
    return F.when(F.col(z) >= 4, "far above").when(F.col(z) >= 2, "above").when(F.col(z) <= -2, "below").when(F.col(z).isNotNull(), "usual")
