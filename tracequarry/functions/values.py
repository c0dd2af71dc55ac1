"""Literals of the query language, and 32-bit float arithmetic on both sides of the API."""

from __future__ import annotations

import math
import re
from decimal import Decimal

import numpy as np

_NUMBER = re.compile(r"[+-]?(?:inf|infinity|nan|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)", re.IGNORECASE | re.ASCII)

Literal = float | bool | str


def literal(token: str) -> Literal:
    """A number if it reads as one, else ``true`` or ``false`` exactly, else text. Numbers are 32-bit floats."""
    if _NUMBER.fullmatch(token):
        with np.errstate(over="ignore"):
            return float(np.float32(token))
    return {"true": True, "false": False}.get(token, token)


def rounding_interval(f: float) -> tuple[float, bool, float, bool]:
    """The doubles that round to the finite 32-bit ``f``: low end, whether it is included, high end, whether it is."""
    x = np.float32(f)
    even = int(x.view(np.uint32)) & 1 == 0
    with np.errstate(over="ignore"):
        down, up = (float(np.nextafter(x, np.float32(s))) for s in (-np.inf, np.inf))
    step = 2.0**104  # of the largest finite values
    low = (float(x) + (down if math.isfinite(down) else float(x) - step)) / 2
    high = (float(x) + (up if math.isfinite(up) else float(x) + step)) / 2
    return low, even, high, even


def shown(value: float) -> str:
    """A 32-bit float as shortest decimal digits, without exponent and without a trailing ``.0``."""
    x = np.float32(value)
    if np.isnan(x):
        return "NaN"
    if np.isinf(x):
        return "inf" if x > 0 else "-inf"
    if x == 0:
        return "-0" if np.signbit(x) else "0"
    return format(Decimal(np.format_float_scientific(x, unique=True, trim="-")), "f")


def percentile_rank(percent: int, count: int) -> int:
    """Rank (from 1) of a percentile among ``count`` values, in 32-bit arithmetic, at most ``count``."""
    share = np.float32(np.float32(percent) / np.float32(100))
    return min(count, int(np.ceil(np.float32(share * np.float32(count)))))
