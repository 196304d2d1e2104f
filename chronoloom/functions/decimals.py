"""Doubles as text with a fixed number of decimals, rounded as their exact binary value demands.

The engine's own formatting rounds the shortest decimal form, so 0.01875 (in binary a little less)
gives 0.0188. Here the product of a fraction and a power of ten is split into its rounded value and
its exact error: only where the rounded product lies on a tie does the error tell the side, and
where that is 0 too, the even digit is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Halves a double's digits: the product with it less the rest has the upper ones alone.
_SPLIT = float((1 << 27) + 1)
_TWO_40 = float(1 << 40)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fixed_text(c: Column, digits: int, signed_zero: bool = True) -> Column:
    """``c`` with 1 to 7 decimals; nan, inf and -inf by name, null as null. What rounds to zero keeps its sign unless
    not ``signed_zero``. Exact up to 1e31; beyond, digits after the seventeenth are zeros."""
    scale = 10.0**digits

    def split(v: Column) -> Column:
        size = F.abs(v)
        whole = F.floor(size).cast("double")
        return _let(F.struct(v.alias("v"), size.alias("size"), whole.alias("whole"), (size - whole).alias("part"), ((size - whole) * scale).alias("product")), rounded)

    def rounded(x: Column) -> Column:
        part, product = x["part"], x["product"]
        upper = part * _SPLIT - (part * _SPLIT - part)
        error = (upper * scale - product) + (part - upper) * scale  # exact, as the scale has few bits
        low = F.floor(product).cast("double")
        up = (product - low > 0.5) | ((product - low == 0.5) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
        return _let(low + F.when(up, 1.0).otherwise(0.0), lambda figure: text(x, figure))

    def text(x: Column, figure: Column) -> Column:
        v, size, carry = x["v"], x["size"], figure >= scale
        high = F.floor(size / _TWO_40).cast("double")  # of large numbers, which have no fraction
        large = (high.cast("bigint").cast("decimal(19,0)") * F.lit(1 << 40).cast("decimal(13,0)") + (size - high * _TWO_40).cast("bigint").cast("decimal(13,0)")).cast("string")
        whole = (x["whole"] + F.when(carry, 1.0).otherwise(0.0)).cast("bigint").cast("string")
        integer = F.when(size < 2.0**62, whole).when(size < 2.0**102, large).otherwise(F.format_string("%.0f", size))
        minus = F.when(v == 0, F.startswith(v.cast("string"), F.lit("-"))).otherwise(v < 0) if signed_zero else (v < 0) & ((x["whole"] > 0) | (figure > 0))
        return F.concat(F.when(minus, "-").otherwise(""), integer, F.lit("."), F.lpad(F.when(carry, 0.0).otherwise(figure).cast("bigint").cast("string"), digits, "0"))

    odd = lambda v: F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    return _let(c.cast("double"), lambda v: F.when(v.isNotNull(), odd(v).otherwise(split(v))))
