"""Joins in which a single key may own a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A task should get about 1/SHARES of all rows of a join. At most SHARES keys
# can hold more than that each, whatever the size of the tables, which bounds
# both the broadcast of the hot keys and the copies made of their right rows.
SHARES = 4096
# Words of 64 bits in a map of keys: the size of what is broadcast, whatever the tables hold.
WORDS = 1 << 16


def join_counted(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    count: str,
    how: str = "inner",
) -> DataFrame:
    """Equi-join in which ``right`` is unique on ``keys`` and knows its fan-in.

    ``right[count]`` says how many rows of ``left`` carry the key. A key with
    more than one share (1/SHARES of the rows) is dealt over as many salts as
    it has shares, so the hottest key splits furthest and no row limit decides:
    its left rows get a salt derived from the row, its right row is repeated
    once per salt, at most ``2 * SHARES`` copies in all. ``right`` is read
    three times, so pass a written table.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    total = right.agg(F.sum(count)).scalar()
    shares = F.ceil(F.col(count) * F.lit(float(SHARES)) / total).cast("int")
    hot = right.select(*keys, shares.alias("salts")).filter(F.col("salts") > 1)
    spread = F.pmod(F.xxhash64(*left.columns), F.coalesce("salts", F.lit(1)).cast("bigint"))
    salted_left = (
        left.join(F.broadcast(hot), keys, "left").withColumn("salt", spread.cast("int")).drop("salts")
    )
    salted_right = right.withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1))
    ).drop(count)
    return salted_left.join(salted_right, [*keys, "salt"], how).drop("salt")


def possible(df: DataFrame, wanted: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key may be in ``wanted``, found without a shuffle of ``df``.

    Every wanted key sets a bit of a map of fixed size, which is broadcast. No
    row with a wanted key is lost; some others pass, more of them the more keys
    there are, so a join is to follow. Wide rows that it would shuffle for
    nothing stay where they are. Rows with a null key go.
    """
    told = with_possible(df, wanted, keys, "__possible")
    return told.filter("__possible").select(*df.columns)


def with_possible(df: DataFrame, wanted: DataFrame, keys: str | Sequence[str], name: str) -> DataFrame:
    """``df`` with a column ``name``: whether the key may be in ``wanted``. False is certain, also for a null key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    code = F.xxhash64(*keys)
    slot = F.shiftrightunsigned(code, 6).bitwiseAND(WORDS - 1).alias("__slot")
    bit = code.bitwiseAND(63).cast("int")
    marked = wanted.select(slot, bit.alias("__bit"))
    words = marked.groupBy("__slot").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__word"))
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    met = df.withColumn("__slot", slot).withColumn("__bit", bit).join(F.broadcast(words), "__slot", "left")
    told = known & F.coalesce(F.expr("getbit(__word, __bit) = 1"), F.lit(False))
    return met.select(*df.columns, told.alias(name))
