"""Rounding as the graph catalogue defines it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 2) -> Column:
    """Round a non-negative double half away from zero, on the double itself and not on its decimal form."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """top / bottom as a double; ``empty`` where the bottom is 0."""
    return F.when(bottom != 0, top.cast("double") / bottom).otherwise(F.lit(empty))


def one_decimal(x: Column) -> Column:
    """A non-negative double (below 2**28) with one decimal, as C's ``%.1f`` shows it: by the double's exact value, ties to even.

    Spark's ``format_string`` rounds the shortest decimal form and ties up: 6.25 and 14.95 (a little less as a double) go wrong.
    The double is split in two parts whose multiples by 20 are exact, so the sign of 20 x - (2 t + 1) is too.
    """
    tenths = F.floor(x * 10)
    high = F.floor(x * 2.0**20) / 2.0**20
    past = (high * 20 - (tenths * 2 + 1)) + (x - high) * 20
    rounded = tenths + F.when(past > 0, 1).when(past == 0, F.pmod(tenths, F.lit(2))).otherwise(0)
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), F.pmod(rounded, F.lit(10)).cast("string"))


def compared(value: Column, op: Column, threshold: Column) -> Column:
    """Comparison by operator name; an unknown name is false."""
    return (
        F.when(op == ">=", value >= threshold)
        .when(op == ">", value > threshold)
        .when(op == "<=", value <= threshold)
        .when(op == "<", value < threshold)
        .when(op == "==", F.abs(value - threshold) < 2.220446049250313e-16)
        .otherwise(F.lit(False))
    )


def json_number(value: Column) -> Column:
    """The number in ``{"value": n}`` or a bare number; null if there is none."""
    return F.coalesce(F.get_json_object(value, "$.value"), value).try_cast("double")
