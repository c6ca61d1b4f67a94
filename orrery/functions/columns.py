"""Column helpers: permissive coercion, strings and arithmetic with the null rules of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def lower_or_null(c: Column | str) -> Column:
    return F.lower(empty_to_null(c))


def to_double(c: Column | str) -> Column:
    """The number that a text holds, or null."""
    return col(c).try_cast("double")


def to_long(c: Column | str) -> Column:
    """The whole number that a text holds, with any fraction cut off, or null."""
    return to_double(c).cast("long")


def cents(c: Column | str) -> Column:
    return to_double(c) / 100


def greatest_null(a: Column, b: Column) -> Column:
    """The greater of two, null if either is: Spark's greatest() skips nulls."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def settled(c: Column, digits: int = 6) -> Column:
    """A sum of floating point numbers as compared with a limit, or before floor and ceil: the order of its parts doesn't decide."""
    return F.round(c, digits)


def half_up(c: Column, digits: int) -> Column:
    """A positive number to so many digits, what is half a step counting as a whole one; float noise doesn't decide."""
    return F.floor(c * 10**digits + 0.5 + 1e-7) / F.lit(float(10**digits))


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    c = col(c)
    whole = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def hour_bin(t: Column, anchor: Column, floor: bool = False) -> Column:
    """Hours between two times in seconds: cut off toward zero, or floored."""
    hours = (t - anchor) / 3600
    return F.floor(hours).cast("long") if floor else hours.cast("long")


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def slug(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def first_fragment(c: Column | str, table: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first fragment that a text contains."""
    out: Column | None = None
    for fragment, label in table:
        out = F.when(F.instr(col(c), fragment) > 0, label) if out is None else out.when(F.instr(col(c), fragment) > 0, label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


#: The limits and names of standings.
LINEAR = 0.0032
BANDS = {"War": -0.999, "Hostile": -0.32, "Enemy": -0.01, "Neutral": 0.01, "Friendly": 0.1, "Friend": 0.5}


def signed_decibel(c: Column) -> Column:
    """A standing in [-1, 1] on a log scale of -30 to 30, linear up to 0.0032, to one decimal."""
    size = F.abs(c)
    return F.bround(clamp(F.when(size <= LINEAR, c / (LINEAR / 5)).otherwise(F.signum(c) * 10 * F.log10(size * 1000)), -30, 30), 1)


def standing_band(c: Column) -> Column:
    """The band of a standing: those below neutral end at their limit, the others before it."""
    out = None
    for name, limit in BANDS.items():
        inside = c <= limit if limit < 0 else c < limit
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.when(c.isNotNull(), "Ally")
