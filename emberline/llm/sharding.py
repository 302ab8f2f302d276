"""Jump consistent hashing onto numbered shards, with gapless slots inside each shard. DataFrame functions only.

A null key counts as 0 and a null text as empty. Repeated rows all get a slot. An empty table gives no rows. Columns
of the input other than the key and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stage

#: Fixed value: multiplier of the 64-bit linear congruential generator of the published algorithm.
MULTIPLIER = 2862933555777941757
#: Groups that the rows of a shard are dealt to when they are numbered; with the shard count it bounds the broadcast.
SUB_BUCKETS = 256
_LOW32 = (1 << 32) - 1


def _times_multiplier_plus_one(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi * 2^32 + lo) * MULTIPLIER + 1 modulo 2^64 on halves of 32 bits, which never overflow a long."""
    mh, ml = MULTIPLIER >> 32, MULTIPLIER & _LOW32

    def low(a: Column, m: int) -> Column:
        """a * m modulo 2^32."""
        upper = F.shiftright(a, 16) * F.lit(m & 0xFFFF) + a.bitwiseAND(F.lit(0xFFFF)) * F.lit(m >> 16)
        return (F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * F.lit(m & 0xFFFF)).bitwiseAND(F.lit(_LOW32))

    first = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(ml) + F.lit(1)
    second = F.shiftright(lo, 16) * F.lit(ml) + F.shiftright(first, 16)
    new_lo = F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16) + first.bitwiseAND(F.lit(0xFFFF))
    new_hi = (F.shiftright(second, 16) + low(hi, ml) + low(lo, mh)).bitwiseAND(F.lit(_LOW32))
    return new_hi, new_lo


def jump(key: Column, shards: int) -> Column:
    """Struct of shard and next: the shard under this count, and the count at which the key would move again.

    The candidate shard rises with each step, so a fold over as many steps as there are shards always ends it.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_LOW32)).alias("lo"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next")
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _times_multiplier_plus_one(s["hi"], s["lo"])
        ahead = F.floor((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        return F.when(s["next"] < shards, F.struct(hi.alias("hi"), lo.alias("lo"), s["next"].alias("shard"), ahead.alias("next"))).otherwise(s)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)
    return F.struct(out["shard"].cast("int").alias("shard"), out["next"].alias("next"))


def assign(df: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """A row for each input row: key, size, text_crc32, shard, slot, and the shard if one more were added."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    narrow = df.select(F.col(key).cast("long").alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), jump(F.col(key), shards).alias("j"))
    narrow = narrow.select(
        "key", "size", "text_crc32", F.col("j.shard").alias("shard"), F.when(F.col("j.next") == shards, F.lit(shards)).otherwise(F.col("j.shard")).cast("int").alias("grown_shard"),
        F.pmod(F.pmod(F.coalesce("key", F.lit(0)), F.lit(SUB_BUCKETS)) + F.col("text_crc32"), F.lit(SUB_BUCKETS)).cast("int").alias("sub"),
    )
    rows = stage.persisted(narrow, "sharding")
    before = W.partitionBy("shard").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "sub").count().select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("shard", "sub").orderBy("key", "size", "text_crc32")
    numbered = rows.withColumn("rank", F.row_number().over(inside))
    return numbered.join(F.broadcast(offsets), ["shard", "sub"]).select("key", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
