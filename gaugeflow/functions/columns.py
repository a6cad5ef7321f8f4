"""Column helpers: exact integer time arithmetic and missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.session import utc_session

DAY_US = 86_400_000_000


def _wall_us(ntz: Column) -> Column:
    """Microseconds of a TIMESTAMP_NTZ as if it were UTC, from its fields: no session zone takes part."""
    day = F.unix_date(ntz.cast("date")).cast("bigint")
    return day * DAY_US + F.hour(ntz).cast("bigint") * 3_600_000_000 + F.minute(ntz).cast("bigint") * 60_000_000 + (F.date_part(F.lit("SECOND"), ntz) * 1_000_000).cast("bigint")


def us_of(ts: str | Column) -> Column:
    """Microseconds since 1970 of a time: a TIMESTAMP is an instant; a TIMESTAMP_NTZ, a DATE and a text without zone are UTC.

    The session's zone makes no difference. A text with a zone or offset after its clock time is that instant.
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    instant = F.unix_micros(c.cast("timestamp"))
    if utc_session():
        return instant
    kind, text = F.typeof(c), F.trim(c.cast("string"))
    wall = _wall_us(c.cast("timestamp_ntz"))
    zoned = text.rlike("[Tt ][0-9]{1,2}.*[A-Za-z+-]")
    return F.when(kind.isin("timestamp_ntz", "date"), wall).when(kind == "string", F.when(zoned, instant).otherwise(wall)).otherwise(instant)


def month_of(us: Column) -> Column:
    """'YYYY-MM' in UTC of microseconds since 1970, whatever the session's zone."""
    day = F.date_from_unix_date(steps_of(us, DAY_US).cast("int"))
    return F.format_string("%04d-%02d", F.year(day), F.month(day))


def floor_us(us: Column, step: Column | int) -> Column:
    """Largest multiple of step not above us; right for negative times and beyond 2**53."""
    return us - F.pmod(us, F.lit(step) if isinstance(step, int) else step)


def steps_of(us: Column, step: Column | int) -> Column:
    """floor(us / step) as BIGINT, without a double in between."""
    s = F.lit(step) if isinstance(step, int) else step
    return F.call_function("div", us - F.pmod(us, s), s)


def round_us(us: Column, step: int) -> Column:
    """Nearest multiple of step, halves up."""
    return floor_us(us + F.lit(step // 2), step)


def known(c: str | Column) -> Column:
    """NaN becomes null, the one form of a missing number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def finite(c: str | Column) -> Column:
    """NaN and both infinities become null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Exactly the named columns; a missing one raises. What else a table carries can't clash with an operator's own names."""
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df.select(*columns)
