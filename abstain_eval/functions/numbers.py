"""Column helpers for draws, rounding, safe casts and number text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def draw_digest(seed: int, stream: str, *keys) -> Column:
    """md5 text of a draw; depends on the row's keys and never on partitioning."""
    parts = [F.lit(str(seed)), F.lit(stream), *[_col(k).cast("string") for k in keys]]
    return F.md5(F.concat_ws("|", *parts))


def digest_uniform(digest: Column, part: int = 0) -> Column:
    """52 bits of a digest as a double in [0, 1); a digest holds two such parts."""
    bits = F.conv(F.substring(digest, 1 + 13 * part, 13), 16, 10).cast("bigint")
    return bits / F.lit(TWO_POW_52)


def hash_uniform(seed: int, stream: str, *keys) -> Column:
    return digest_uniform(draw_digest(seed, stream, *keys))


def digest_normal(digest: Column) -> Column:
    """Standard normal draw by the Box-Muller formula on both parts of one digest."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - digest_uniform(digest, 0)))
    return radius * F.cos(F.lit(2.0 * math.pi) * digest_uniform(digest, 1))


def round_half_up(c, digits: int) -> Column:
    """Decimal rounding that agrees across engines; symmetric for negative values.

    The argument is used several times: pass a column, not a costly expression.
    """
    c = _col(c)
    scale = float(10**digits)
    size = F.abs(c)
    rounded = F.signum(c) * (F.floor(size * scale + 0.5).cast("double") / scale)
    return F.when(size < TWO_POW_52 / scale, rounded).otherwise(c)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def finite_or_null(c) -> Column:
    """NaN and infinities have no JSON form."""
    c = _col(c)
    return F.when(is_finite(c), c)


def bounded_number(c, lower: float, fallback: float) -> Column:
    """Null, text and non-finite values become the fallback; the rest is floored."""
    number = _col(c).try_cast("double")
    return F.when(is_finite(number), F.greatest(number, F.lit(lower))).otherwise(F.lit(fallback))


def clamp(c, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value on either side; null stays null."""
    c = _col(c)
    limited = c if high is None else F.least(c, F.lit(high))
    limited = limited if low is None else F.greatest(limited, F.lit(low))
    return F.when(c.isNotNull(), limited)


def ratio(numerator, denominator) -> Column:
    """Double ratio, null when the denominator is zero."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def number_text(c) -> Column:
    """Shortest decimal text of a double, with plain digits between 1e-4 and 1e16."""
    c = _col(c).cast("double")
    text = c.cast("string")
    size = F.abs(c)
    plain = F.rtrim(text.try_cast("decimal(38,18)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    # The JVM may print one digit more than needed; sixteen are taken when they suffice.
    short = F.format_string("%.15e", c)
    digits = F.rtrim(F.rtrim(F.substring_index(short, "e", 1), F.lit("0")), F.lit("."))
    long_digits = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    mantissa = F.when(short.try_cast("double") == c, digits).otherwise(long_digits)
    exponent = F.substring_index(short, "e", -1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(c == float("inf"), F.lit("inf"))
        .when(c == float("-inf"), F.lit("-inf"))
        .when((c == 0) | ((size >= 1e-3) & (size < 1e7)), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )
