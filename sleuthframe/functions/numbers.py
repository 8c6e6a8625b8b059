"""Numbers as Python rounds and writes them, from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dekker's constant for double precision: it splits a number into two halves whose products are exact.
SPLIT = float(2**27 + 1)
#: From here on a double has no binary places left.
WHOLE = float(2**52)


def exact_product(a: Column, b: float) -> tuple[Column, Column]:
    """a * b as the nearest double and what that leaves out."""
    c = a * SPLIT
    high = c - (c - a)
    low = a - high
    b_high = SPLIT * b - (SPLIT * b - b)
    b_low = b - b_high
    product = a * F.lit(b)
    return product, ((high * b_high - product) + high * b_low + low * b_high) + low * b_low


def python_round(x: Column, digits: int = 0) -> Column:
    """``round(x, digits)``: the exact binary value to the nearest decimal, half to even; digits 0 to 15.

    2.675 is a little less than its name says and gives 2.67; 2.25 is exact and gives 2.2. Numbers beyond 2^52 / 10^digits, NaN and infinite
    ones stay as they are.
    """
    if not 0 <= digits <= 15:
        raise ValueError("digits must be between 0 and 15")
    x, scale = x.cast("double"), 10.0**digits
    size = F.abs(x)
    product, rest = exact_product(size, scale)
    below = F.floor(product).cast("double")
    over = (product - below - 0.5) + rest
    even = F.pmod(below, F.lit(2.0)) == 0
    near = F.when(over > 0, below + 1).when(over < 0, below).when(even, below).otherwise(below + 1)
    # where the product was rounded up to a whole number, what is left of it lies below
    near = F.when((product == below) & (rest < -0.5), below - 1).otherwise(near) / scale
    plain = x.isNull() | F.isnan(x) | (size * scale >= WHOLE)
    return F.when(plain, x).otherwise(F.when(x < 0, -near).otherwise(near))


def shorter(text: Column, size: Column) -> Column:
    """A number's text with one digit less behind the point if that still is the number, else as it is."""
    mantissa, exponent = F.substring_index(text, "E", 1), F.regexp_extract(text, "E.*$", 0)
    whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    kept = F.length(part) - 1
    down = F.concat(whole, F.substring(part, F.lit(1), kept))
    up = (down.cast("decimal(38,0)") + 1).cast("string")
    up = F.lpad(up, F.greatest(F.length(up), F.length(down)), "0")

    def written(digits: Column) -> Column:
        return F.concat(F.substring(digits, F.lit(1), F.length(digits) - kept), F.lit("."), F.substring(digits, F.length(digits) - kept + 1, kept), exponent)

    last = F.substring(part, -1, 1).cast("int")
    near = F.regexp_replace(F.when(last >= 5, written(up)).otherwise(written(down)), r"(\.\d+?)0+(?=E|$)", "$1")
    return F.when((kept > 0) & (near.try_cast("double") == size), near).otherwise(text)


def python_text(x: Column) -> Column:
    """``repr(x)`` of a double: the shortest digits that give the number back, with an exponent below 1e-4 and from 1e16 on."""
    x = x.cast("double")
    size = F.abs(x)
    special = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    # Java before release 19 finds a digit too many here and there
    text = F.when(special.isNull(), shorter(size.cast("string"), size))
    digits = F.regexp_replace(text, r"\.0E|E", "e")
    mantissa, exponent = F.substring_index(digits, "e", 1), F.substring_index(digits, "e", -1).try_cast("int")
    signed = F.when(exponent < 0, "-").otherwise("+")
    power = F.abs(exponent).cast("string")
    short = F.concat(mantissa, F.lit("e"), signed, F.lpad(power, F.greatest(F.length(power), F.lit(2)), "0"))
    large = F.regexp_replace(text.try_cast("decimal(38,12)").cast("string"), "0+$", "")
    large = F.when(large.endswith("."), F.concat(large, F.lit("0"))).otherwise(large)
    small = F.regexp_replace(text.try_cast("decimal(38,30)").cast("string"), "0+$", "")
    shown = F.when(~text.contains("E"), text).when((size >= 1e16) | (size < 1e-4), short).when(size >= 1e7, large).otherwise(small)
    negative = x.cast("string").startswith("-")
    return F.coalesce(special, F.when(negative, F.concat(F.lit("-"), shown)).otherwise(shown))
