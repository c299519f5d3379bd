"""Clamps, scales, bands and weighted indexes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null, which greatest and least would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def scale(x: Column, low: float, high: float) -> Column:
    """Place of x between low and high, clamped to 0..1; 0 if the bounds are not in order."""
    return clamp((x - low) / (high - low)) if high > low else F.lit(0.0)


def band(x: Column, bands: Sequence[tuple[float, object]], otherwise: object = None, inclusive: bool = True) -> Column:
    """The first band whose upper bound x doesn't exceed (or reach, if not inclusive)."""
    out = None
    for top, value in bands:
        fits = x <= top if inclusive else x < top
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(otherwise)


def weighted_index(factors: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean of factors, clamped to 0..1."""
    total = sum((factors[k] * w for k, w in weights.items()), F.lit(0.0))
    return clamp(total / sum(weights.values()))


def gaussian(x: Column, centre: float, spread: float) -> Column:
    return F.exp(-0.5 * F.pow((x - centre) / spread, 2))


def geometric_mean(*parts: Column) -> Column:
    product = parts[0]
    for p in parts[1:]:
        product = product * p
    return F.pow(product, F.lit(1.0 / len(parts)))


def snap_half_up(x: Column, step: float) -> Column:
    """Nearest multiple of step, halves towards plus infinity."""
    return F.floor(x / step + 0.5) * step


def snap_half_even(x: Column, step: float) -> Column:
    return F.bround(x / step) * step


def first_nonzero(*parts: Column) -> Column:
    """The first part that is neither null nor 0."""
    return F.coalesce(*(F.nullif(p, F.lit(0)) for p in parts))


def compact_number(x: Column) -> Column:
    """1234 as 1.2k, 2500000 as 2.5m, 1200000000 as 1200.0m."""
    plain = lambda y: F.replace(F.format_number(y, 1), F.lit(","), F.lit(""))
    return (
        F.when(x >= 1_000_000, F.concat(plain(x / 1_000_000), F.lit("m")))
        .when(x >= 1000, F.concat(plain(x / 1000), F.lit("k")))
        .otherwise(x.cast("string"))
    )


def largest(*parts: Column) -> Column:
    """The largest of measures that overlap, which must not be added; nulls are skipped, also a single part may be given."""
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def sum_of_known(*parts: Column) -> Column:
    """The sum of measures that don't overlap; null if none is known."""
    known = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    return F.when(F.coalesce(*parts).isNotNull(), known)
