"""Alert candidates, severity, de-duplication as an ordered fold, and the inbox."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

LEVELS = ["watch", "high", "critical"]
#: Parts of facility kinds that raise the severity by one level.
HAZARDOUS = ("refinery", "lng", "chemical", "petrochemical", "oil", "gas", "fuel", "explosive", "fertili")
_ID_LIKE = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^(osm|wri|gem|nightfire|viirs)[:_-]"


@dataclass(frozen=True)
class Rules:
    p_fire: float = 0.6
    frp_z: float = 3.0
    max_age_hours: float = 24.0
    min_frp: float = 5.0
    dedupe_hours: float = 6.0
    veto_crop: float = 0.6
    veto_night: float = 0.2


def severity_rank(frp: Column, kind: Column) -> Column:
    base = F.when(frp >= 100, 2).when(frp >= 40, 1).otherwise(0)
    return F.least(base + F.coalesce(F.lower(kind).rlike("|".join(HAZARDOUS)), F.lit(False)).cast("int"), F.lit(2))


def level(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), rank)


def _text(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def at_facility() -> Column:
    return _text("site_ref").isNotNull() & F.coalesce(F.col("site_within"), F.lit(False))


def facility_key() -> Column:
    return F.when(at_facility(), _text("site_ref")).otherwise(F.concat(F.lit("src:"), F.col("source_id").cast("string")))


def display_name() -> Column:
    shown = lambda c: F.when(~_text(c).rlike(_ID_LIKE), _text(c))
    return F.coalesce(shown("site_name"), shown("site_ref"))


def judged(sources: DataFrame, now: Column, rules: Rules = Rules()) -> DataFrame:
    """Sources that pass a threshold, with trigger and vetoed (the signature of field burning)."""
    p, z = F.col("class_scores")["industrial_fire_candidate"], F.nanvl(F.col("frp_z").cast("double"), F.lit(None).cast("double"))
    by_p, by_z = F.coalesce(p >= rules.p_fire, F.lit(False)), F.coalesce(at_facility() & (z >= rules.frp_z), F.lit(False))
    fresh = F.col("last_seen") >= now - F.make_interval(hours=F.lit(int(rules.max_age_hours)))
    s = sources.filter(fresh & (F.col("frp_max") >= rules.min_frp)).withColumns({"p_fire": p, "_p": by_p, "_z": by_z}).filter("_p or _z")
    veto = F.coalesce((F.col("lc_crop") >= rules.veto_crop) & (F.col("night_fraction") < rules.veto_night), F.lit(False))
    return s.withColumns({"trigger": F.when(F.col("_p") & F.col("_z"), "both").when(F.col("_p"), "p_fire").otherwise("frp_z"), "vetoed": veto}).drop("_p", "_z")


def candidates(sources: DataFrame, now: Column, rules: Rules = Rules()) -> DataFrame:
    """The strongest candidate of each facility; ties go to the smallest source id."""
    c = judged(sources, now, rules).filter(~F.col("vetoed")).withColumns({"facility_key": facility_key(), "severity_rank": severity_rank(F.col("frp_max"), F.col("site_kind"))})
    best = W.partitionBy("facility_key").orderBy(F.desc("severity_rank"), F.desc("frp_max"), "source_id")
    c = c.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")
    return c.withColumn("severity", level(F.col("severity_rank"))).withColumn("summary", summary())


def summary() -> Column:
    kind = F.replace(F.when(at_facility(), F.coalesce(_text("site_kind"), F.lit("facility"))).otherwise("facility"), F.lit("_"), F.lit(" "))
    where = F.when(at_facility(), F.coalesce(display_name(), F.concat(F.lit("an unnamed "), kind))).otherwise("an unmapped location")
    bits = F.concat_ws(
        "; ",
        F.when(F.col("trigger").isin("p_fire", "both"), F.format_string("P(industrial fire) %.0f%%", 100 * F.col("p_fire"))),
        F.when(F.col("trigger").isin("frp_z", "both"), F.format_string("power %+.1f sd above this facility's own baseline", F.col("frp_z").cast("double"))),
    )
    peak = F.coalesce(F.format_string("peak %.0f MW", F.col("frp_max")), F.lit("peak power unknown"))
    return F.concat(F.upper("severity"), F.lit(": possible industrial fire at "), where, F.lit(" ("), kind, F.lit("), "), F.coalesce(_text("state"), F.lit("India")), F.lit(" - "), peak, F.lit("; "), bits)


def _opened(key: str, gap: int, side: str):
    """Rows in order of key, _us and _rn, with created. What is kept of a key is the time of its last alert."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, None
        for batch in batches:
            keys, us, first = batch.column(key), batch.column("_us"), batch.column("_rn").to_numpy() == 1
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy()
            times, created = us.fill_null(-1).to_numpy(), np.zeros(batch.num_rows, bool)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [batch.num_rows]])
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                name = (keys[int(a)].as_py(),)
                last = last if name == before else None
                before = name
                at = np.flatnonzero(first[a:b] & us.is_valid().to_numpy(zero_copy_only=False)[a:b]) + a  # one row for each time
                t, i = times[at], 0
                while True:
                    i = i if last is None else max(i, int(np.searchsorted(t, last + gap, side)))
                    if i >= len(t):
                        break
                    created[at[i]], last, i = True, int(t[i]), i + 1
            yield pa.record_batch([*(batch.column(n) for n in batch.schema.names[:-2]), pa.array(created)], [*batch.schema.names[:-2], "created"])

    return run


def dedupe(events: DataFrame, hours: float = 6.0, key: str = "facility_key", ts: str = "ts", at_limit_new: bool = True) -> DataFrame:
    """Adds created: an event opens an alert unless one was created less than hours before; suppressed events do not
    extend it. at_limit_new: whether an event exactly hours later opens a new one. Of events at one time the first by the
    other columns opens it; an event without a time opens none.

    Rows are sorted by facility and time and read in Arrow batches that jump from alert to alert; no facility's times
    are gathered. A pause as long as the limit always opens a new alert, so a facility is cut into stretches there, and
    those of a busy one are dealt over tasks; the pauses are found by a window that streams its rows.
    """
    gap = int(hours * 3_600_000_000)
    others = [F.col(c) for c in events.columns if c not in (key, ts)] or [F.lit(1)]
    e = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    e = e.withColumn("_rn", F.row_number().over(W.partitionBy(key, "_us").orderBy(*others)))
    in_time = W.partitionBy(key).orderBy("_us", "_rn")
    pause = F.col("_us") - F.lag("_us").over(in_time)
    fresh = pause >= gap if at_limit_new else pause > gap
    e = e.withColumn("_fresh", (F.coalesce(fresh, F.lit(False)) & (F.col("_rn") == 1)).cast("int"))
    e = e.withColumn("_stretch", F.sum("_fresh").over(in_time.rowsBetween(W.unboundedPreceding, 0)))
    rows = e.repartition(key, "_stretch").sortWithinPartitions(key, "_us", "_rn").select(*events.columns, "_us", "_rn")
    schema = StructType([*events.schema.fields, StructField("created", BooleanType())])
    return rows.mapInArrow(_opened(key, gap, "left" if at_limit_new else "right"), schema)


def refreshed(events: DataFrame, key: str = "facility_key", ts: str = "ts") -> DataFrame:
    """One row per alert: peak, highest severity and latest values of the events that it took in."""
    opened = W.partitionBy(key).orderBy(ts, F.desc("created")).rowsBetween(W.unboundedPreceding, 0)
    numbered = events.withColumn("alert_no", F.sum(F.col("created").cast("int")).over(opened))
    return numbered.groupBy(key, "alert_no").agg(F.min(ts).alias("created_at"), F.max(ts).alias("last_seen"), F.max("frp").alias("peak_frp"), F.max("severity_rank").alias("severity_rank"), F.count("*").alias("n_events"))


def capped(new: DataFrame, cycle: str, limit: int = 10) -> DataFrame:
    """Adds deferred: all but the first limit new alerts of a cycle, by severity and power."""
    order = W.partitionBy(cycle).orderBy(F.desc("severity_rank"), F.desc("frp"), "facility_key")
    return new.withColumn("deferred", F.row_number().over(order) > limit)


def inbox(alerts: DataFrame, limit: int) -> DataFrame:
    """Open ones first, then by level and age."""
    return alerts.orderBy((F.col("status") == "open").desc(), (F.col("severity") == "critical").desc(), (F.col("severity") == "high").desc(), F.desc("created_at"), "alert_id").limit(limit)


def timeline(alert: DataFrame) -> DataFrame:
    """Typed events of each alert in time order, as an array."""
    event = lambda ts, kind, note: F.struct(F.col(ts).cast("timestamp").alias("ts"), F.lit(kind).alias("kind"), note.cast("string").alias("note"))
    events = F.array(event("first_seen", "first_detection", F.lit("")), event("peak_at", "peak", F.format_string("%.0f MW", F.col("frp_max"))), event("created_at", "alert_created", F.col("severity")), event("decided_at", "decision", F.col("decision")))
    return alert.withColumn("timeline", F.array_sort(F.filter(events, lambda e: e["ts"].isNotNull())))


def retries_due(deliveries: DataFrame, now: Column, attempts: int = 5, hours: int = 24) -> DataFrame:
    """Failed deliveries that are tried again."""
    return deliveries.filter((~F.col("ok")) & (F.col("attempts") < attempts) & (F.col("created_at") >= now - F.make_interval(hours=F.lit(hours))))
