"""Bid-rent expressions: R(d) = r0 * exp(-lam * d)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ramp from low to high rents, the rings and curve points, and the index that stands for rents without samples.
RAMP = ["#cde2fb", "#9ec5f4", "#6da7ec", "#3987e5", "#256abf", "#184f95", "#0d366b"]
RINGS, CURVE_POINTS, BASE_INDEX, EDGE_RATIO, DEFAULT_D_MAX, MIN_D_MAX = 6, 80, 100.0, 4.0, 5.0, 0.3


def rent_at(distance_km: Column, r0: Column, lam: Column) -> Column:
    return r0 * F.exp(-lam * distance_km)


def ramp_colour(norm: Column) -> Column:
    """The ramp's colour at 0 to 1; halves round to even."""
    place = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), norm)) * (len(RAMP) - 1)).cast("int")
    return F.element_at(F.array(*map(F.lit, RAMP)), place + 1)


def ring_index(distance_km: Column, step_km: Column, rings: int = RINGS) -> Column:
    """0-based ring; a point within 1e-9 of the outer edge is in the last ring; null outside."""
    inner = F.floor(distance_km / step_km).cast("int")
    return F.when(inner < rings, inner).when(distance_km <= step_km * rings + 1e-9, F.lit(rings - 1))


def half_distance(lam: Column) -> Column:
    return F.when(F.abs(lam) > 1e-6, F.log(F.lit(2.0)) / F.abs(lam))


def rent_label(value: Column, is_index: bool, unit: str = "") -> Column:
    return F.format_string("%.1f/100", value) if is_index else F.trim(F.concat(F.format_number(value, 0), F.lit(f" {unit}")))
