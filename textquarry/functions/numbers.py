"""Numbers written in Han characters, and their formatting."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import col

# Digits, and the units within and above ten thousand.
DIGITS = {c: n for n, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
TENS, LARGE = {"十": 10, "百": 100, "千": 1000}, {"万": 10_000, "亿": 100_000_000}


def han_value(text: str | None) -> float | None:
    """The value of Han or Arabic digits with units and 点 for the decimal point; None for anything else.

    Digits in a row are read by place; a unit multiplies what stands before it, a large one all since the last larger one.
    """
    t = re.sub(r"[\s,，]", "", text or "")
    if not t:
        return None
    if re.fullmatch(r"\d+(?:\.\d+)?", t):
        return float(t)
    if (m := re.fullmatch(r"(\d+(?:\.\d+)?)([万亿]+)", t)) is not None:
        value = float(m[1])
        for unit in m[2]:
            value *= LARGE[unit]
        return value
    whole, point, rest = t.partition("点")
    large = ""
    while rest and rest[-1] in LARGE:  # 一点五万
        large, rest = rest[-1] + large, rest[:-1]
    if point and (not rest or any(c not in DIGITS for c in rest)):
        return None
    total, section, digits = 0, 0, None
    for c in whole:
        if c in DIGITS or c.isdigit():
            digits = (digits or 0) * 10 + (DIGITS[c] if c in DIGITS else int(c))
        elif c in TENS:
            section, digits = section + (1 if digits is None else digits) * TENS[c], None
        elif c in LARGE:
            section += digits or 0
            total = (total + section) * LARGE[c] if LARGE[c] > 10_000 else total + (section or 1) * LARGE[c]
            section, digits = 0, None
        else:
            return None
    value = float(total + section + (digits or 0))
    for k, c in enumerate(rest, 1):
        value += DIGITS[c] / 10**k
    for unit in large:
        value *= LARGE[unit]
    return value


@F.pandas_udf(DoubleType())
def han_decimal(values: pd.Series) -> pd.Series:
    return values.map(han_value)


def format_number(c) -> Column:
    """At most eight decimals, no trailing zeros."""
    fixed = F.format_string("%.8f", col(c))
    return F.regexp_replace(fixed, r"\.?0+$", "")
