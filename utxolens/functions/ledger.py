"""Column expressions of the ledger jobs. No UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the analysis.
DUST_SATS = 546
ROUND_SATS = 10_000
QUICK_BLOCKS, LONG_BLOCKS = 144, 1008
FEE_ERA = 1_420_070_400
POOLS = (500_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000)


def is_dust(value: Column) -> Column:
    return (value > 0) & (value < DUST_SATS)


def is_round(value: Column) -> Column:
    return (value > 0) & (value % ROUND_SATS == 0)


def vsize(weight: Column) -> Column:
    return F.ceil(weight / 4).cast("long")


def fee_rate(fee: Column, weight: Column) -> Column:
    return fee / F.nullif(vsize(weight), F.lit(0))


def fee_band(rate: Column) -> Column:
    return F.when(rate < 3, "low").when(rate <= 15, "average").when(rate <= 80, "high").when(rate.isNotNull(), "very_high")


def custody_percent(address: Column, script: Column, spent: Column) -> Column:
    """Custodial likelihood in hundredths, 0 to 95."""
    points = F.when((script == "p2sh") | address.startswith("3"), 35).otherwise(0)
    points = points + F.when((script == "v1_p2tr") | address.startswith("bc1p"), 40).otherwise(0)
    points = points + F.when(address.startswith("bc1q") & (F.length(address) == 62), 15).otherwise(0)
    points = points + F.when(~F.coalesce(spent, F.lit(True)), 15).otherwise(0)
    return F.when(address.isNull(), 0).otherwise(F.least(F.lit(95), points))


def dwell(spend_height: Column, height: Column) -> Column:
    return F.when(spend_height >= height, spend_height - height)


def tier(share: Column) -> Column:
    return F.when(share >= 0.75, "High").when(share >= 0.35, "Medium").when(share > 0.02, "Low").otherwise("Clean")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, wherever the optimizer moves the expression: it is bound by a lambda, not repeated in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
