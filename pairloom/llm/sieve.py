"""Telling rows whose key is surely not in a set from those whose key may be, by a bit map of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map: 2 MB, whatever the number of keys.
BITS = 1 << 24


def sieve(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in no row of keys, the others); `key` names a long that is a hash in both.

    Each key sets one of BITS bits; the map is summed where the keys lie and broadcast, so rows that it tells apart need no shuffle. Where
    keys are many the map is full and tells nothing apart, which costs a shuffle, never a row. Null keys are in no set."""
    place = (F.pmod(F.col(key), F.lit(BITS)) + 1).alias("_place")
    bits = keys.where(F.col(key).isNotNull()).select(place).groupBy(F.expr("bitmap_bucket_number(_place)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_place))").alias("_bits"))
    asked = rows.select("*", place).withColumn("_bucket", F.expr("bitmap_bucket_number(_place)")).join(F.broadcast(bits), "_bucket", "left")
    byte = "cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_place) div 8 + 1 as int), 1)), 16, 10) as int)"
    hit = F.coalesce(F.expr(f"shiftright({byte}, cast(bitmap_bit_position(_place) % 8 as int)) & 1"), F.lit(0)) == 1
    return tuple(asked.where(x).select(*rows.columns) for x in (~hit, hit))
