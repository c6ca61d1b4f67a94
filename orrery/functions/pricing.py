"""Prices on a cosine between a ware's least, mean and greatest price.

A fill u (0: empty, SPAN and more: full) has a position s in [-1, 1], and that a
price in the band: 1 is the greatest, 0 the mean and -1 the least. Bands may be
lopsided, so each side of the mean has its own scale.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clamp

# The fill at which the price is least, and by what an offer's kind shifts its fill.
SPAN = 1.095
SHIFT = {"supplier": 0.053, "ration": 0.006, "input": -0.039, "yard": -0.202}
# Credits that cap a supplier's target, the position of self-supply, what a locked buyer bids below the mean,
# factors of shady prices (of the mean, of the greatest), knee and width of build storages, exponent of yards.
VALUE_CAP, SUPPLIES, LOCKED_DISCOUNT = 5_000_000.0, 0.5, 1.0
SHADY_FIXED, SHADY_CONTINUUM = 2.750, 1.042
KNEE, WIDTH, YARD_POWER = 0.50, 0.65, 2.62


def position(fill: Column, span: float = SPAN) -> Column:
    return F.cos(math.pi * clamp(fill / span, 0.0, 1.0))


def fill(position: Column, span: float = SPAN) -> Column:
    """The inverse of position(); a position at either end doesn't tell how far beyond it the fill lies."""
    return F.acos(clamp(position, -1.0, 1.0)) * span / math.pi


def price(position: Column, low: Column, mean: Column, high: Column) -> Column:
    return mean + position * F.when(position < 0, mean - low).otherwise(high - mean)


def position_of(price: Column, low: Column, mean: Column, high: Column) -> Column:
    """The inverse of price(); 0 on a side of no width."""
    side = F.when(price < mean, mean - low).otherwise(high - mean)
    return F.coalesce(F.try_divide(price - mean, side), F.when(price.isNotNull() & (side == 0), 0.0))


def capped_target(allocation: Column, mean: Column, cap: float = VALUE_CAP) -> Column:
    """What a supplier fills up to: its allocation, or fewer units if these are worth `cap`; the allocation where no mean price is known."""
    return F.when(mean > 0, F.least(allocation, cap / mean)).otherwise(allocation)


def main_price(net: Column, target: Column, low: Column, mean: Column, high: Column, shift: Column) -> Column:
    """The price of a stock `net` on the way to a target; null without a target."""
    return F.when(target > 0, price(position(net / target + shift), low, mean, high))


def locked_price(mean: Column, side: Column) -> Column:
    return F.when(side == "sell", mean).otherwise(mean - LOCKED_DISCOUNT)


def shady_tier(seen: Column, mean: Column, high: Column) -> Column:
    """Which of the two shady prices the seen one is nearer to."""
    return F.when(F.abs(seen - SHADY_FIXED * mean) <= F.abs(seen - SHADY_CONTINUUM * high), "fixed").otherwise("continuum")


def shady_price(tier: Column, mean: Column, high: Column) -> Column:
    return F.when(tier == "fixed", SHADY_FIXED * mean).otherwise(SHADY_CONTINUUM * high)


def band_price(band: Column, low: Column, high: Column) -> Column:
    """The price at a share of the band, 0 at its least price."""
    return low + band * (high - low)


def build_band(fill: Column) -> Column:
    """The share of the band that a build storage pays: all up to the knee, then falling in a line."""
    return F.when(fill <= KNEE, 1.0).otherwise(clamp(1 - (fill - KNEE) / WIDTH, 0.0, 1.0))


def yard_band(fill: Column) -> Column:
    return clamp(1 - F.pow(F.greatest(fill, F.lit(0.0)), F.lit(YARD_POWER)), 0.0, 1.0)
