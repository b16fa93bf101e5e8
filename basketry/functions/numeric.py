"""Exact numeric building blocks.

Results are compared value by value against another engine, and a double
sum depends on the order rows arrive in.  So money stays DECIMAL, means are
rounded from integer cents, and sample standard deviations come from exact
integer moments.  All helpers return Columns (JVM expressions) and are
safe inside ``groupBy().agg()``: they decompose into partial aggregates.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_TYPE = "decimal(18,2)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a: Column, b: Column) -> Column:
    """SQL integral division ``a div b`` (exact, bigint)."""
    return F.call_function("div", a, b)


def cents(c: Column | str) -> Column:
    """A DECIMAL(·,2) money value as exact integer cents."""
    return (_c(c) * 100).cast("bigint")


def hundredths_to_money(h: Column) -> Column:
    """Integer hundredths -> DECIMAL(18,2), exact."""
    return (h.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY_TYPE)


def rounded_mean_from_parts(s: Column, n: Column) -> Column:
    """Mean rounded to 2 places (half away from zero) from exact cents sum ``s`` and count ``n``.

    ``(2|s| + n) div (2n)`` is the nearest hundredth of |s|/n with ties going
    up; the sign is restored afterwards.  NULL when n = 0.
    """
    s = s.cast("bigint")
    n = n.cast("bigint")
    q = F.when(n > 0, idiv(F.abs(s) * 2 + n, n * 2))
    return hundredths_to_money(F.when(s < 0, -q).otherwise(q))


def exact_rounded_mean(c: Column | str) -> Column:
    """round(avg(c), 2) for a DECIMAL(·,2) column, exact; one aggregate expression."""
    c = _c(c)
    return rounded_mean_from_parts(F.sum(cents(c)), F.count(c))


def _square_cents(k: Column) -> Column:
    """k² exactly as DECIMAL(20,0): a bigint product while |k| < 3·10⁹ cents (no overflow),
    decimal multiplication beyond (never reached by item prices, but exact if it is)."""
    small = F.abs(k) < F.lit(3_000_000_000)
    kd = k.cast("decimal(20,0)")
    return F.when(small, (k * k).cast("decimal(20,0)")).otherwise((kd * kd).cast("decimal(20,0)"))


def exact_sample_stddev(c: Column | str) -> Column:
    """stddev_samp of a DECIMAL(·,2) column from exact integer moments; NULL when n < 2.

    variance = (n·Σk² − (Σk)²) / (n·(n−1)) over cents k.  Σk is a bigint sum and
    Σk² a DECIMAL sum of per-row bigint squares, so the hot per-row path stays
    in long arithmetic and no partial sum can overflow; numerator and
    denominator are exact, then one double division, sqrt and /100.
    """
    c = _c(c)
    k = cents(c)
    n = F.count(c).cast("decimal(38,0)")
    s1 = F.sum(k).cast("decimal(38,0)")
    s2 = F.sum(_square_cents(k)).cast("decimal(38,0)")
    num = n * s2 - s1 * s1
    den = n * (n - 1)
    return F.when(F.count(c) > 1, F.sqrt(num.cast("double") / den.cast("double")) / 100.0)


def round_to(c: Column, places: int, type_: str | None = None, half_even: bool = False) -> Column:
    """Round half away from zero to ``places`` as DECIMAL, like SQL ``round(x::numeric, n)``;
    ``half_even=True`` rounds ties to even (the dataframe-library convention)."""
    t = type_ or f"decimal(38,{places})"
    rounder = F.bround if half_even else F.round
    return rounder(c.cast("decimal(38,12)"), places).cast(t)


def safe_divide(a: Column, b: Column) -> Column:
    """a / nullif(b, 0) as double: NULL instead of an ANSI division error."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def percent(a: Column, b: Column, places: int = 1) -> Column:
    """round(100·a/b, places); NULL when b is 0 or NULL."""
    return round_to(safe_divide(a, b) * 100.0, places)
