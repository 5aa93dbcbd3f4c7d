"""Deriving ``estimated_cost_usd`` for usage records.

* ``with_list_cost``: LEFT validity join of usage to time-bounded list prices
  (price valid at ``usage_start_time``; start inclusive, end exclusive, open
  end when ``price_end_time`` is NULL).  An unpriced record keeps a NULL cost.
* ``with_catalog_cost``: rate of the fixed SKU catalogue, 0.20 for an unknown
  SKU.

The validity join has one plan at every size of the price table: two equi-joins with
an index of the periods (``price_index``).  Building it starts no job.  Whether a side
is broadcast is left to Spark, which goes by the size of the index's files or rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_RATE, MONEY, RATE, SKU_CATALOG

def _quantity(usage: DataFrame) -> DataFrame:
    if usage.schema["usage_quantity"].dataType != MONEY:
        usage = usage.withColumn("usage_quantity", F.col("usage_quantity").cast(MONEY))
    return usage


# Price periods are indexed by the stretches of this many seconds that they touch.
PRICE_BUCKET = 28 * 86400


@dataclass(frozen=True)
class PriceIndex:
    """Price periods arranged for equi-joins.

    Of each SKU, ``_s_from`` is the last instant at which any of its prices starts or ends.
    ``standing`` (_s_sku, _s_from, _s_rate) holds the prices that run without end from then
    on; ``dated`` (_p_sku, _p_bucket, _p_start, _p_end, _p_rate) holds all periods before
    it, a row for each bucket of time that a period touches.  An instant has prices in one
    of the two at most.
    """
    dated: DataFrame
    standing: DataFrame

    DATED = "_p_sku STRING, _p_bucket BIGINT, _p_start TIMESTAMP, _p_end TIMESTAMP, _p_rate DECIMAL(10,4)"
    STANDING = "_s_sku STRING, _s_from TIMESTAMP, _s_rate DECIMAL(10,4)"


def _bucket(micros: Column) -> Column:
    seconds = F.floor(micros / 1e6).cast("bigint")
    return seconds - F.pmod(seconds, F.lit(PRICE_BUCKET))


def price_index(prices: DataFrame) -> PriceIndex:
    """Index of (sku_name, pricing.default, price_start_time, price_end_time) rows.  Periods
    without a SKU or a start, or that end before they start, never hold and are left out.
    Write it with ``sources.usage_io.write_price_index`` to build it once."""
    p = (prices.select(F.col("sku_name").alias("_sku"), F.col("pricing.default").cast(RATE).alias("_rate"),
                       F.col("price_start_time").alias("_start"), F.col("price_end_time").alias("_end"))
         .where("_sku IS NOT NULL AND _start IS NOT NULL AND (_end IS NULL OR _end > _start)"))
    change = F.max(F.greatest("_start", "_end")).over(Window.partitionBy("_sku"))
    p = p.withColumn("_from", change)
    until = F.least(F.coalesce("_end", "_from"), F.col("_from"))
    dated = (p.withColumn("_until", until).where("_start < _until")
             .select(F.col("_sku").alias("_p_sku"),
                     F.explode(F.sequence(_bucket(F.unix_micros("_start")),
                                          _bucket(F.unix_micros("_until") - 1),
                                          F.lit(PRICE_BUCKET).cast("bigint"))).alias("_p_bucket"),
                     F.col("_start").alias("_p_start"), F.col("_until").alias("_p_end"),
                     F.col("_rate").alias("_p_rate")))
    standing = p.where("_end IS NULL").select(F.col("_sku").alias("_s_sku"),
                                              F.col("_from").alias("_s_from"),
                                              F.col("_rate").alias("_s_rate"))
    return PriceIndex(dated, standing)


def with_list_cost(usage: DataFrame, prices: DataFrame | PriceIndex) -> DataFrame:
    """usage + ``estimated_cost_usd = round(quantity * rate, 4)`` at the list price valid
    when the record starts.

    The usage meets the dated prices on (SKU, bucket of time) and the standing ones on the
    SKU; a record matches in one of the two at most, so a record covered by several
    overlapping periods appears once for each, as in a plain left join on the validity.
    A small index is broadcast and moves no usage.  Beyond Spark's threshold both joins are
    shuffled: the first spreads a hot SKU over the buckets of time, and adaptive execution
    splits what is still too large.
    """
    usage = _quantity(usage)
    if "estimated_cost_usd" in usage.columns:
        usage = usage.drop("estimated_cost_usd")
    index = prices if isinstance(prices, PriceIndex) else price_index(prices)
    sku, at = F.col("sku_name"), F.col("usage_start_time")
    rate = F.coalesce("_p_rate", "_s_rate")
    return (usage
            .join(index.dated, (sku == F.col("_p_sku"))
                  & (_bucket(F.unix_micros(at)) == F.col("_p_bucket"))
                  & (at >= F.col("_p_start")) & (at < F.col("_p_end")), "left")
            .join(index.standing, (sku == F.col("_s_sku")) & (at >= F.col("_s_from")), "left")
            .withColumn("estimated_cost_usd",
                        F.round(F.col("usage_quantity") * rate, 4).cast(MONEY))
            .drop(*[c for d in (index.dated, index.standing) for c in d.columns]))


def catalog_rate():
    """Rate of the fixed catalogue as a literal map lookup (no join needed)."""
    pairs = []
    for name, rate, _cat in SKU_CATALOG:
        pairs += [F.lit(name), F.lit(Decimal(rate)).cast("decimal(10,4)")]
    return F.coalesce(F.create_map(*pairs)[F.col("sku_name")],
                      F.lit(Decimal(DEFAULT_RATE)).cast("decimal(10,4)"))


def with_catalog_cost(usage: DataFrame, catalog: DataFrame | None = None,
                      default_rate: str = DEFAULT_RATE) -> DataFrame:
    """usage + ``estimated_cost_usd = round(quantity * rate[sku], 4)``.

    With no ``catalog`` the fixed SKU catalogue is applied as a map lookup;
    a caller-supplied catalogue (sku_name, rate) is joined, broadcast if Spark finds it small.
    """
    usage = _quantity(usage)
    if "estimated_cost_usd" in usage.columns:
        usage = usage.drop("estimated_cost_usd")
    if catalog is None:
        rate = catalog_rate()
        return usage.withColumn("estimated_cost_usd",
                                F.round(F.col("usage_quantity") * rate, 4).cast(MONEY))
    c = catalog.select(F.col("sku_name").alias("_c_sku"),
                       F.col("rate").cast("decimal(10,4)").alias("_c_rate"))
    rate = F.coalesce(F.col("_c_rate"), F.lit(Decimal(default_rate)).cast("decimal(10,4)"))
    return (usage.join(c, F.col("sku_name") == F.col("_c_sku"), "left")
            .withColumn("estimated_cost_usd",
                        F.round(F.col("usage_quantity") * rate, 4).cast(MONEY))
            .drop("_c_sku", "_c_rate"))
