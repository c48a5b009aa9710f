"""Numbers as text, rounded half-even on the exact binary value (as ``f"{x:,.2f}"`` and ``f"{x:.1%}"`` do)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2^56 x 100 still fits a long
_BITS = 56


def fixed_text(x: Column, digits: int, grouped: bool = False) -> Column:
    """``x`` (a double below 9e16) with 0 to 2 digits after the point; ``grouped`` sets thousands apart.

    Java's formats round the shortest decimal of a double half up, so 0.15 and 6.25
    come out differently there. Here every step is exact: the fraction is cut into twice 56
    bits and a flag for what lies below them, and the digits come from integer arithmetic.
    """
    if not 0 <= digits <= 2:
        raise ValueError("0 to 2 digits")
    scale = 10**digits
    size = F.abs(x)
    whole = F.floor(size)
    scaled = (size - whole) * float(1 << _BITS)
    bits = F.floor(scaled)
    fine = (scaled - bits) * float(1 << _BITS)  # the next 56 bits
    fine_bits = F.floor(fine)
    fine_product = fine_bits * scale
    carry = F.shiftright(fine_product, _BITS)
    below = (fine != fine_bits) | (fine_product != F.shiftleft(carry, _BITS))
    product = bits * scale + carry
    quotient = F.shiftright(product, _BITS)
    rest = product - F.shiftleft(quotient, _BITS)
    half = F.lit(1 << (_BITS - 1))
    down = whole * scale + quotient
    up = (rest > half) | ((rest == half) & (below | (down % 2 == 1)))
    total = down + F.when(up, 1).otherwise(0)
    units = F.call_function("div", total, F.lit(scale))
    text = F.format_number(units, 0) if grouped else units.cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((total % scale).cast("string"), digits, "0"))
    return F.concat(F.when(x < 0, "-").otherwise(""), text)


def percent_text(x: Column, digits: int = 1) -> Column:
    """A ratio as a percentage."""
    return F.concat(fixed_text(x * 100, digits), F.lit("%"))


def count_text(x: Column) -> Column:
    """An integer with thousands set apart."""
    return F.format_number(x, 0)


def money_text(x: Column) -> Column:
    """A decimal with two digits after the point and thousands set apart."""
    return F.format_number(x, 2)
