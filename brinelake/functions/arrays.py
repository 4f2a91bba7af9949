"""Array, axis and vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinelake.functions.sentences import col_of

# Directional grid and plot constants.
DIRECTION_STEP = 5
DEFAULT_SPREAD = 20.0
LEAST_SPREAD = 1.0
BUBBLE_SCALE = 40.0
LEAST_BUBBLE = 5.0


def decode_array(text: Column | str) -> Column:
    """JSON text to an array of numbers; nulls inside stay."""
    return F.from_json(col_of(text), "array<double>")


def encode_array(values: Column | str) -> Column:
    """Array of numbers to JSON text; nulls inside stay."""
    return F.to_json(col_of(values), {"ignoreNullFields": "false"})


def frequency_axis(start: Column | str, step: Column | str, n: Column | str) -> Column:
    """X11: ``n`` frequencies from ``start``, rounded to 4 digits; empty where n is not positive."""
    s, d, count = (col_of(c).cast("double") for c in (start, step, n))
    return F.transform(_positions(count), lambda i: F.round(s + i * d, 4))


def _positions(count: Column) -> Column:
    return F.when(count >= 1, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(
        F.array().cast("array<int>"))


def speed(east: Column | str, north: Column | str) -> Column:
    """X7."""
    e, n = col_of(east).cast("double"), col_of(north).cast("double")
    return F.sqrt(e * e + n * n)


def direction(east: Column | str, north: Column | str, compass: bool = False) -> Column:
    """Degrees from north, in (-180, 180], or in [0, 360) with ``compass``."""
    d = F.degrees(F.atan2(col_of(east).cast("double"), col_of(north).cast("double")))
    return F.pmod(d, F.lit(360.0)) if compass else d


def zeros(n: Column | str) -> Column:
    return F.array_repeat(F.lit(0.0), col_of(n).cast("int"))


def pad(values: Column | str, length: Column) -> Column:
    """Array filled up with 0 to a length."""
    v = col_of(values)
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(length - F.size(v), F.lit(0))))


def no_nulls(values: Column | str) -> Column:
    return F.transform(col_of(values), lambda x: F.coalesce(x, F.lit(0.0)))


def peak_position(energy: Column | str) -> Column:
    """Position of the first largest value, counted from 0; missing counts as 0."""
    e = no_nulls(energy)
    return (F.array_position(e, F.array_max(e)) - 1).cast("int")


def mean_step(axis: Column | str) -> Column:
    """Mean difference of neighbours; 0.01 for axes of one value."""
    a = col_of(axis)
    n = F.size(a)
    steps = F.zip_with(F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))),
                       F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda y, x: y - x)
    total = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n > 1, total / (n - 1)).otherwise(F.lit(0.01))


def spread_weight(theta: Column, mean: Column, spread: Column) -> Column:
    """Gaussian weight of the shortest angle between a bin and the mean direction."""
    angle = F.pmod(theta - mean + 180.0, F.lit(360.0)) - 180.0
    return F.exp(-0.5 * F.pow(angle / spread, F.lit(2.0)))


def bubble_size(energy: Column | str) -> Column:
    """D12."""
    e = F.coalesce(col_of(energy).cast("double"), F.lit(0.0))
    return F.greatest(F.lit(LEAST_BUBBLE), F.sqrt(e) * BUBBLE_SCALE)
