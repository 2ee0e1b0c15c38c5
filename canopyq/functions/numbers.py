"""Numbers as short text, scales and clamps."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def fixed_text(x: float, digits: int) -> str:
    """x with so many digits; the exact binary value is rounded, ties away from zero."""
    text = str(Decimal(abs(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return f"-{text}" if x < 0 else text


def short_number(x: float | None, most: int = 2) -> str | None:
    """Millions and thousands with one digit, small numbers with more."""
    if x is None or x != x or x in (float("inf"), float("-inf")):
        return None
    if x > 1e6:
        return fixed_text(x / 1e6, 1) + "M"
    if x > 1e3:
        return fixed_text(x / 1e3, 1) + "k"
    return fixed_text(x, min(most, 2) if x < 1 else 1 if x < 10 else 0)


@pandas_udf(StringType())
def short_number_udf(x: pd.Series) -> pd.Series:
    """No built-in rounds a double's exact binary value half up, hence Python here."""
    return x.map(short_number, na_action="ignore")


def half_up(x: Column) -> Column:
    """The nearest whole number, halves towards positive infinity."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float, high: float, offset: float = 0.0) -> Column:
    return F.greatest(F.lit(low), F.least(x + F.lit(offset), F.lit(high)))


def unit(x: Column, low: float, high: float) -> Column:
    """x between low and high as 0 to 1."""
    return clamp((x - F.lit(low)) / F.lit(high - low), 0.0, 1.0)


def color_parts(rate: Column) -> list[Column]:
    """Red, green and blue of a rate from 0 to 1: blue to red, green at both ends."""
    return [rate * 250, F.abs(rate - 0.5) * 440, F.lit(255) - rate * 250]


def color_text(rate: Column) -> Column:
    r, g, b = (F.floor(c).cast("string") for c in color_parts(rate))
    return F.concat(F.lit("rgb("), r, F.lit(","), g, F.lit(","), b, F.lit(")"))


def plural(n: Column, word: str) -> Column:
    """The word, with an s if n is over 1."""
    return F.when(n > 1, F.lit(f"{word}s")).otherwise(F.lit(word))


def percent(rate: Column) -> Column:
    return F.round(rate * 100, 2)


def color_steps(each: int = 5) -> Column:
    """The scale's colours at steps of so many percent up to 100, as ``--color-range-<percent>: r, g, b;``."""
    at = F.sequence(F.lit(each), F.lit(100), F.lit(each))
    part = lambda c: F.floor(c + F.lit(0.5) + F.lit(1e-9)).cast("string")
    return F.transform(at, lambda n: F.concat(F.lit("--color-range-"), n.cast("string"), F.lit(": "), F.concat_ws(", ", *map(part, color_parts(n / 100))), F.lit(";")))


def color_bucket(start: float, end: float, place: Column, count: Column) -> tuple[Column, Column]:
    """Start and end of the place-th (from 0) of count equal parts of a colour range."""
    step = F.lit(float(end - start)) / count
    return F.lit(float(start)) + step * place, F.lit(float(start)) + step * (place + 1)


def the_one(expanded: Column, own: Column, none: Column, this: Column, other: Column) -> Column:
    """none if nothing is expanded, this for the expanded one, other for the rest."""
    return F.when(expanded.isNull(), none).when(expanded == own, this).otherwise(other)


def value_steps(n: Column | int, low: float, high: float) -> Column:
    """n values at equal steps from low on, high left out."""
    n = F.lit(n) if isinstance(n, int) else n
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.lit(float(low)) + i * (F.lit(float(high - low)) / n))


def polygon(corners: int) -> Column:
    """Corners of a regular polygon on the unit circle, the first one to the right."""
    angle = lambda i: i * F.lit(2.0) * F.pi() / corners
    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda i: F.struct(F.cos(angle(i)).alias("x"), F.sin(angle(i)).alias("y")))


#: Heights, in elements, over which a level's control shows how many, and top or bottom.
SLOT_HEIGHTS = (3.2, 4.8)


def control_slots(height: Column) -> list[Column]:
    """Whether a control has room for each of its two optional parts."""
    return [height > least for least in SLOT_HEIGHTS]


def label_width(labels: Column) -> Column:
    """Width that the longest of some labels asks for."""
    return (F.array_max(F.transform(labels, F.length)) * 0.8 + 2) * 20


def timer_state(tick: Column, children: int) -> tuple[Column, Column]:
    """Which child is open and which is expanded after a tick (from 0); nulls for none.

    Four ticks a child: open, expand, rest, fold; then one that starts anew.
    """
    at = F.pmod(tick, F.lit(4 * children + 1))
    child, phase = F.floor(at / 4).cast("int"), at % 4
    ends = at == 4 * children
    return F.when(~ends & (phase != 3), child), F.when(~ends & phase.isin(1, 2), child)
