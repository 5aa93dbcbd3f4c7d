"""A broadcast filter of fixed size for semi-joins on key sets of any size.

The hashes of the keys set bits of ``WORDS`` 64-bit words, which one aggregation builds.
The words are at most WORDS rows however many keys there are, so they can be broadcast
without a look at the data.  A row whose key is in the set always passes; others pass the
more often, the more keys there are, up to all of them.  What passes is then joined or
counted exactly.  Plan and result are the same at every size; only the work saved differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 16  # 16 bytes each when broadcast


def _word(h: Column) -> Column:
    return F.pmod(h, F.lit(WORDS))


def _bit(h: Column) -> Column:
    place = F.pmod(F.shiftright(h, WORDS.bit_length() - 1), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def sieve(keys: DataFrame, h: str) -> DataFrame:
    """(_word, _bits) of a set of 64-bit hashes in column ``h``."""
    return keys.groupBy(_word(F.col(h)).alias("_word")).agg(F.bit_or(_bit(F.col(h))).alias("_bits"))


def sift(rows: DataFrame, h: Column, filter_: DataFrame) -> DataFrame:
    """``rows`` without most of those whose hash ``h`` is not in the set of ``filter_``; a
    key set that turns out empty ends the scan before it starts."""
    return (rows.withColumn("_word", _word(h)).join(F.broadcast(filter_), "_word")
            .where(F.col("_bits").bitwiseAND(_bit(h)) != 0).drop("_word", "_bits"))
