"""Expressions over small sorted arrays: slopes of a window, circular smoothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def theil_sen(samples: str) -> Column:
    """Median of all pairwise slopes, in units a minute, of array<struct<t: seconds, v: double>>; pairs at one instant don't count."""
    pairs = f"flatten(transform({samples}, (a, i) -> transform(filter(slice({samples}, i + 2, size({samples})), b -> b.t > a.t), b -> (b.v - a.v) * 60D / (b.t - a.t))))"
    return F.expr(f"""
        transform(array(array_sort({pairs})), s -> case when size(s) = 0 then null
            else (element_at(s, cast((size(s) + 1) div 2 as int)) + element_at(s, cast(size(s) div 2 + 1 as int))) / 2D end)[0]""")


def smooth_circular(values: str, half: int) -> Column:
    """Triangular weights 1..h+1..1 around each value, wrapping over the values there are; fewer than h stay as they are."""
    n = f"size({values})"
    total = " + ".join(f"{half + 1 - abs(j)} * element_at({values}, cast(pmod(i + {j}, {n}) + 1 as int))" for j in range(-half, half + 1))
    return F.expr(f"case when {n} < {max(half, 1)} then {values} else transform({values}, (v, i) -> ({total}) / {float((half + 1) ** 2)}D) end")
