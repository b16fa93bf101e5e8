"""Timestamp functions with warehouse semantics.

Timestamps are zone-less (TIMESTAMP_NTZ).  Month truncation returns a DATE
(``trunc``), because ``date_trunc`` on NTZ gives back a zoned timestamp.
Differences are taken in exact microseconds; elapsed whole days are the
day field of the interval (24-hour days), which is not ``datediff``'s
calendar-boundary count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import hundredths_to_money, idiv

MICROS_PER_DAY = 86_400_000_000


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_timestamp_ntz(c: Column | str) -> Column:
    """Text (or timestamp) -> TIMESTAMP_NTZ; bad text fails under ANSI, NULL stays NULL."""
    return _c(c).cast("timestamp_ntz")


def try_timestamp_ntz(c: Column | str) -> Column:
    """Tolerant variant: unparseable text becomes NULL."""
    return F.try_to_timestamp(_c(c).cast("string")).cast("timestamp_ntz")


def month_start(c: Column | str) -> Column:
    """First day of the month as DATE (``date_trunc('month', ts)::date``)."""
    return F.trunc(_c(c), "MM")


def year_of(c: Column | str) -> Column:
    """Calendar year as bigint."""
    return F.year(_c(c)).cast("bigint")


def month_of(c: Column | str) -> Column:
    """Month number (1-12) as bigint."""
    return F.month(_c(c)).cast("bigint")


def year_month_label(c: Column | str) -> Column:
    """'YYYY-MM' text label."""
    return F.date_format(_c(c), "yyyy-MM")


def micros_between(later: Column | str, earlier: Column | str) -> Column:
    """Exact microseconds from ``earlier`` to ``later`` (bigint)."""
    return F.timestamp_diff("MICROSECOND", _c(earlier), _c(later))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Fractional days between two timestamps (``extract(epoch from a-b)/86400``), double."""
    return micros_between(later, earlier).cast("double") / float(MICROS_PER_DAY)


def elapsed_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole elapsed 24-hour days (``extract(day from a-b)``), truncated toward zero."""
    m = micros_between(later, earlier)
    q = idiv(F.abs(m), F.lit(MICROS_PER_DAY))
    return F.when(m < 0, -q).otherwise(q)


def gap_days_2dp(micros: Column) -> Column:
    """Fractional days rounded to 2 places (half away from zero) from exact microseconds, DECIMAL."""
    a = F.abs(micros)
    h = idiv(a * 200 + MICROS_PER_DAY, F.lit(2 * MICROS_PER_DAY))
    return hundredths_to_money(F.when(micros < 0, -h).otherwise(h))
