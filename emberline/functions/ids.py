"""Content-derived identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: namespace of facility identifiers.
FACILITY_NAMESPACE = "5a1d3c9e-4d8f-4a55-9d6e-7b7c0f3a2c11"


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID of version 5, from SHA-1 alone."""
    raw = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(raw, 17, 1), "0123456789abcdef", "89ab" * 4)
    part = lambda at, n: F.substring(raw, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def detection_id(product: Column, lat: Column, lon: Column, ts: Column) -> Column:
    """First 20 hex digits of SHA-1 over product, rounded coordinates and UTC time."""
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.substring(F.sha1(F.concat_ws("|", product, F.format_string("%.5f", lat), F.format_string("%.5f", lon), stamp)), 1, 20)


def content_hash(tags: Column, geometry: Column) -> Column:
    """MD5 over the tags in key order and the geometry text."""
    return F.md5(F.concat_ws("|", canonical_json(tags), geometry))


def canonical_json(tags: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


def source_base_id(lat: Column, lon: Column) -> Column:
    """ts-<lat*100>_<lon*100>, with every minus sign, that of the prefix too, written as m."""
    part = lambda v: F.bround(v * 100).cast("long").cast("string")
    return F.replace(F.concat(F.lit("ts-"), part(lat), F.lit("_"), part(lon)), F.lit("-"), F.lit("m"))
