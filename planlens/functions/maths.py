"""The math functions as Catalyst expressions; same names as the interpreter's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PI = F.pi


def _floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; null for divisor 0."""
    return F.when(b != 0, a - b * F.floor(a / F.when(b != 0, b)))


def gcd(a: Column, b: Column) -> Column:
    """Euclid in a fold: 93 steps settle any two 64-bit numbers."""
    start = F.struct(F.abs(a).cast("bigint").alias("a"), F.abs(b).cast("bigint").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step)["a"]


MATH: dict[str, Callable[..., Column]] = {
    "permutation": lambda n, r: F.factorial(n) / F.factorial(n - r),
    "choose": lambda n, r: F.factorial(n) / (F.factorial(r) * F.factorial(n - r)),
    "factorial": F.factorial,
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(a, b),
    "power": F.pow,
    "sqrt": lambda x: F.floor(F.sqrt(x)),
    "remainder": _floor_mod,
    "reminder": _floor_mod,
    "negate": lambda x: -x,
    "inverse": lambda x: F.try_divide(F.lit(1.0), x),
    "negate_prob": lambda p: 1 - p,
    "floor": F.floor,
    "log": lambda x, b: (F.ln(x) / F.ln(b)).cast("bigint"),
    "gcd": gcd,
    "lcm": lambda a, b: F.abs(a * b) / F.when(gcd(a, b) != 0, gcd(a, b)),
    "max_number": F.array_max,
    "min_number": F.array_min,
    "speed": lambda d, t: F.try_divide(d, t),
    "diagonal": F.hypot,
    "rectangle_area": lambda a, b: a * b,
    "rectangle_perimeter": lambda a, b: 2 * (a + b),
    "triangle_area": lambda b, h: 0.5 * b * h,
    "rhombus_area": lambda a, b: 0.5 * a * b,
    "square_area": lambda s: s * s,
    "square_perimeter": lambda s: 4 * s,
    "square_edge_by_area": F.sqrt,
    "square_edge_by_perimeter": lambda p: p / 4,
    "circle_area": lambda r: _PI() * r * r,
    "circumface": lambda r: 2 * _PI() * r,
    "surface_sphere": lambda r: 4 * _PI() * r * r,
    "volume_sphere": lambda r: 4 / 3 * _PI() * F.pow(r, F.lit(3)),
    "volume_cylinder": lambda r, h: _PI() * r * r * h,
    "surface_cylinder": lambda r, h: 2 * _PI() * r * (r + h),
    "volume_cone": lambda r, h: _PI() * r * r * h / 3,
    "volume_cube": lambda s: F.pow(s, F.lit(3)),
    "surface_cube": lambda s: 6 * s * s,
    "cube_edge_by_volume": lambda v: F.pow(v, F.lit(1 / 3)),
}
