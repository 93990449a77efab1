"""Numeric column helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(c: str | Column, digits: int) -> Column:
    """Round half up on the binary value: floor(x * 10^d + 0.5) / 10^d.

    Spark's ``round`` rounds the *decimal text* of a double half-up (2.675 ->
    2.68) while Python and most engines see the binary value (2.67). This
    form gives the same double in every engine that follows IEEE arithmetic.
    NaN, infinities and values so large that the scaled value has no fraction
    pass through unchanged.
    """
    scale = float(10 ** digits)
    x = col_of(c).cast("double")
    rounded = (F.floor(x * scale + 0.5) / scale).cast("double")
    return F.when(F.abs(x * scale) < F.lit(2.0 ** 52), rounded).otherwise(x)


def safe_div(num: str | Column, den: str | Column, default: float | None = 0.0) -> Column:
    """num / den; ``default`` when den is 0 or null (ANSI-safe)."""
    q = F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def per(num: str | Column, den: str | Column, floor_den: float) -> Column:
    """num / greatest(den, floor_den)."""
    return col_of(num).cast("double") / F.greatest(col_of(den).cast("double"), F.lit(float(floor_den)))


def step_band(value: str | Column, cuts: list[tuple[float, str]], otherwise: str,
              inclusive_upper: bool = False) -> Column:
    """First band whose cut the value reaches.

    ``inclusive_upper=False``: value >= cut (descending cuts).
    ``inclusive_upper=True``: value <= cut (ascending cuts).
    """
    v = col_of(value)
    expr = None
    for cut, label in cuts:
        cond = (v <= F.lit(cut)) if inclusive_upper else (v >= F.lit(cut))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise)) if expr is not None else F.lit(otherwise)


def literal_map(mapping: dict, key: str | Column, default) -> Column:
    """Lookup in a literal map; missing or null key -> default."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col_of(key)), F.lit(default))
