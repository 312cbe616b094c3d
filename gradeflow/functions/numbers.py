"""The shortest text of a double that reads back as the same double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bind

# Between these, the JVM's text is short; 17 digits tell all doubles apart. The
# least doubles have one or two digits.
LENGTHS = (1, 2, 15, 16, 17)
WORD = 2**53
EXACT = (1e17, 8e34)  # whole numbers whose digits are worked out exactly


def _cut(t: Column) -> Column:
    """The digits without zeros at either end, and where the point stands before the first one."""
    left = F.regexp_replace(t["digits"], "^0+", "")
    point = t["point"] - (F.length(t["digits"]) - F.length(left))
    return F.struct(F.regexp_replace(left, "0+$", "").alias("digits"), point.alias("point"))


def _shortest(value: Column, t: Column) -> Column:
    """As few digits as still read back as the value, rounded from those given.

    The JVM's 17th digit may be off, so 16 digits are tried on either side too.
    """
    found = t
    for n, off in ((n, off) for n in reversed(LENGTHS) for off in ((1, -1, 0) if n == 16 else (0,))):
        unit = F.rpad(F.lit("1"), F.length(t["digits"]) - (n - 1), F.lit("0")).cast("decimal(38,0)")
        number = F.call_function("div", t["digits"].cast("decimal(38,0)") + F.call_function("div", unit, F.lit(2)), unit)
        number = (number + off).cast("string")
        power = t["point"] - n
        back = F.concat(number, F.lit("E"), power.cast("string")).cast("double")
        less = F.struct(F.regexp_replace(number, "0+$", "").alias("digits"), (power + F.length(number)).alias("point"))
        found = F.when((F.length(t["digits"]) > n) & (back == value), less).otherwise(found)
    return found


def _layout(t: Column) -> Column:
    digits, point, n = t["digits"], t["point"], F.length(t["digits"])
    zeros = lambda k: F.repeat(F.lit("0"), k)
    plain = (F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits))
             .when(point >= n, F.concat(digits, zeros(point - n), F.lit(".0")))
             .otherwise(F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, n))))
    power = F.abs(point - 1).cast("string")
    exponent = F.concat(F.when(point > 0, F.lit("e+")).otherwise(F.lit("e-")), F.lpad(power, F.greatest(F.length(power), F.lit(2)), F.lit("0")))
    rest = F.when(n > 1, F.concat(F.lit("."), digits.substr(F.lit(2), n))).otherwise(F.lit(""))
    # From 1e-4 to below 1e16 numbers are written without an exponent.
    return F.when((point > -4) & (point <= 16), plain).otherwise(F.concat(digits.substr(F.lit(1), F.lit(1)), rest, exponent))


def float_text(col: Column) -> Column:
    """A double as Python and JSON writers print it; null stays null.

    The JVM's own text always reads back, but may have digits too many, which go. Its last digit
    may also be off for large whole numbers, so theirs are worked out from two halves.
    """
    value = F.abs(col.cast("double"))
    text = value.cast("string")
    whole, part = F.split_part(F.split_part(text, F.lit("E"), F.lit(1)), F.lit("."), F.lit(1)), F.split_part(
        F.split_part(text, F.lit("E"), F.lit(1)), F.lit("."), F.lit(2))
    power = F.coalesce(F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0))
    upper = F.floor(value / WORD)
    exact = (upper.cast("decimal(20,0)") * F.lit(WORD).cast("decimal(17,0)") + (value - upper * float(WORD)).cast("long")).cast("string")
    raw = F.when((value >= EXACT[0]) & (value < EXACT[1]), F.struct(exact.alias("digits"), F.length(exact).alias("point"))).otherwise(
        F.struct(F.concat(whole, part).alias("digits"), (F.length(whole) + power).alias("point")))

    def shown(t: Column) -> Column:
        return bind(_shortest(value, t), _layout)

    sign = F.when((col < 0) | (text == "0.0") & col.cast("double").cast("string").startswith("-"), "-").otherwise("")
    finite = F.when(value == 0, F.lit("0.0")).otherwise(bind(raw, lambda r: bind(_cut(r), shown)))
    return (F.when(F.isnan(col), F.lit("NaN")).when(value == float("inf"), F.concat(sign, F.lit("Infinity")))
            .otherwise(F.concat(sign, finite)))
