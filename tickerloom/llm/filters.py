"""A fixed-size filter of keys that tasks can hold whatever the size of the table behind it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 23


def key_filter(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Bitmap of ``2**bits`` hash places (1 MB by default) with the places of all keys set.

    The places are gathered by an aggregate with at most ``2**bits / 64`` rows, which bounds what reaches the driver.
    Keys that are not in the table may pass as well: use it to drop rows early, and join afterwards.
    """
    place = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    words = keys.select(place.alias("p")).select(
        F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")
    )
    table = np.zeros(1 << (bits - 6), np.uint64)
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # one job, and no row objects
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def place_of(column: str, bits: int = BITS):
    """The place of a row's key, to be selected beside the row and looked up by :func:`passes`."""
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def passes(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (table[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1


def semi_filter(rows: DataFrame, column: str, keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``rows`` without most of those whose ``column`` is no ``key`` of ``keys``, by Spark expressions alone.

    The bitmap is a table of at most ``2**bits / 64`` rows (2 MB by default), which bounds the broadcast.
    """
    places = keys.select(place_of(key, bits).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("__word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("__bits")
    )
    placed = rows.withColumn("__place", place_of(column, bits))
    hit = placed.join(F.broadcast(words), F.shiftright("__place", 6) == F.col("__word"))
    return hit.filter("(shiftrightunsigned(__bits, cast(__place & 63 as int)) & 1) = 1").drop("__place", "__word", "__bits")
