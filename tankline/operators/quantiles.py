"""Exact medians of keys that may hold any number of distinct values.

The aggregate ``percentile`` keeps a map from value to count for each key in one task. Here the median is
found digit by digit in the order-preserving bits of the values: a round counts the values of a key
that share the digits found so far by their next DIGIT bits, and goes on with the digit in which the
middle lies. Counts combine map-side, a key has at most 2**DIGIT of them in a round, and four rounds
settle a double. Rows are joined with the two targets of their key: where these are few Spark sends
them to all tasks, else the join is one that AQE splits where a key is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written_once

DIGIT = 16


def _bits(x: Column) -> Column:
    return F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("long")  # -0.0 is 0.0


def _turned(bits: Column) -> Column:
    """Longs that sort as the doubles of the bits do, and back: negative ones have their other bits turned."""
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, ``name``): the median of ``value`` of each key, the mean of the two middle ones for an even number.

    NULL values do not count; a key without others has NULL. NaN is above all numbers. A NULL key is a key.
    """
    x = F.col(value).cast("double")
    # a key in one column, so that NULL keys meet
    bits = df.select(F.to_json(F.struct(*keys)).alias("_key"), *keys, F.when(x.isNotNull(), _bits(x)).alias("_bits"))
    rows = written_once(bits.select("_key", *keys, _turned(F.col("_bits")).alias("_u")), "ordered")
    names = rows.groupBy("_key").agg(*(F.first(k).alias(k) for k in keys), F.count("_u").alias("_n"))
    rows = rows.filter("_u is not null").select("_key", "_u")
    ranks = F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))
    targets = written_once(names.filter("_n > 0").select("_key", F.posexplode(ranks).alias("_end", "_rank"), F.lit(0).cast("long").alias("_found")), "targets")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        first = shift == 64 - DIGIT
        asked = targets.select("_key", "_found").distinct()
        above = F.lit(0).cast("long") if first else F.shiftright("_u", shift + DIGIT)
        digit = F.shiftright("_u", shift) if first else F.shiftright("_u", shift).bitwiseAND(F.lit(2**DIGIT - 1))
        counts = rows.withColumn("_found", above).join(asked, ["_key", "_found"]).groupBy("_key", "_found", digit.alias("_digit")).agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy("_key", "_found").orderBy("_digit"))
        met = targets.join(counts.withColumn("_upto", upto), ["_key", "_found"]).filter("_rank < _upto and _rank >= _upto - _c")
        found = F.col("_digit") if first else F.shiftleft("_found", DIGIT) + F.col("_digit")
        targets = written_once(met.select("_key", "_end", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank"), found.alias("_found")), "targets")
    back = F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), _turned(F.col("_found"))).cast("double")
    ends = targets.select("_key", back.alias("_x")).groupBy("_key").agg(F.when(F.min("_x") == F.max("_x"), F.min("_x")).otherwise(F.avg("_x")).alias(name))
    return names.join(ends, "_key", "left").select(*keys, name)
