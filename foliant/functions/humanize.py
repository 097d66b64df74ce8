"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def _said(n: Column) -> Column:
    return n.cast("string")


def binary_bytes(n: Column) -> Column:
    """``45.7 MiB``: units of 1024, one decimal, cut off."""
    out = F.concat(_said(n), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        whole = F.shiftright(n, 10 * k)
        tenth = F.expr("bigint(0)") + F.shiftright(F.shiftright(n, 10 * (k - 1)).bitwiseAND(F.lit(1023)) * 10, 10)
        out = F.when(n >= F.lit(1 << (10 * k)), F.concat(_said(whole), F.lit("."), _said(tenth), F.lit(f" {unit}"))).otherwise(out)
    return out


def duration(ms: Column) -> Column:
    """``620ms``, ``31.4s``, ``2m 07s``; below zero is zero."""
    ms = F.greatest(ms, F.lit(0)).cast("long")
    second = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(_said(ms), F.lit("ms")))
        .when(second < 60, F.concat(_said(second), F.lit("."), _said(F.floor(ms % 1000 / 100)), F.lit("s")))
        .otherwise(F.concat(_said(F.floor(second / 60)), F.lit("m "), F.lpad(_said(second % 60), 2, "0"), F.lit("s")))
    )


def count(n: Column) -> Column:
    """``8,213,409``."""
    return F.format_number(n, 0)


def spaced_count(n: Column) -> Column:
    """``8 213 409``."""
    return F.translate(count(n), ",", " ")


def _one_decimal(value: Column) -> Column:
    """``%.1f`` as C prints a double in [1, 1024): by its exact binary value, ties to even.

    Java's formatter rounds the shortest decimal instead. value * 2^52 is a whole
    number; ten times it is put together from its upper and lower bits.
    """
    whole = (value * F.lit(float(1 << 52))).cast("long")
    low = whole.bitwiseAND(F.lit((1 << 20) - 1)) * 10
    high = F.shiftright(whole, 20) * 10 + F.shiftright(low, 20)
    tenths, rest, least = F.shiftright(high, 32), high.bitwiseAND(F.lit((1 << 32) - 1)), low.bitwiseAND(F.lit((1 << 20) - 1))
    half = F.lit(1 << 31)
    up = F.when((rest > half) | ((rest == half) & (least > 0)), 1).when(rest == half, tenths % 2).otherwise(0)
    tenths = tenths + up
    return F.concat(_said(F.floor(tenths / 10)), F.lit("."), _said(tenths % 10))


def decimal_bytes(n: Column) -> Column:
    """``1.5 MB``: units of 1000, one decimal, rounded."""
    out, value = F.concat(_said(n), F.lit(" B")), n.cast("double")
    for unit in ("KB", "MB", "GB", "TB"):
        big = value >= 1000
        value = value / 1000.0
        said = F.when(value < 1024, _one_decimal(value)).otherwise(F.format_string("%.1f", value)) if unit == "TB" else _one_decimal(value)
        out = F.when(big, F.concat(said, F.lit(f" {unit}"))).otherwise(out)
    return out


def age(mtime: Column, now: int) -> Column:
    """today, ``12d ago``, ``3mo ago``, ``2y ago``."""
    days = F.greatest(F.floor((F.lit(now) - mtime) / DAY), F.lit(0))
    return F.when(days < 1, "today").when(days < 30, F.concat(_said(days), F.lit("d ago"))).when(days < 365, F.concat(_said(F.floor(days / 30)), F.lit("mo ago"))).otherwise(F.concat(_said(F.floor(days / 365)), F.lit("y ago")))


def freshness(built: Column, now: int) -> Column:
    """just now, ``5m``, ``3h``, ``12d``, ``3mo``, ``2y`` since a snapshot was built."""
    minutes = F.floor(F.greatest(F.lit(now) - built, F.lit(0)) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(_said(minutes), F.lit("m"))).when(hours < 24, F.concat(_said(hours), F.lit("h"))).when(days < 30, F.concat(_said(days), F.lit("d"))).when(days < 365, F.concat(_said(F.floor(days / 30)), F.lit("mo"))).otherwise(F.concat(_said(F.floor(days / 365)), F.lit("y")))


def iso_date(mtime: Column) -> Column:
    """``2024-02-29`` in the session's time zone."""
    return F.date_format(F.timestamp_seconds(mtime), "yyyy-MM-dd")


def epoch_day(mtime: Column) -> Column:
    """Days since 1970-01-01, UTC."""
    return F.floor(mtime / DAY)


def utc_date(mtime: Column) -> Column:
    """``2024-02-29`` in UTC; 1970-01-01 for times at or before it."""
    return F.date_format(F.date_from_unix_date(F.greatest(epoch_day(mtime), F.lit(0)).cast("int")), "yyyy-MM-dd")


def result_count(n: Column, cap: int) -> Column:
    """The number of results, with a plus where the cap was met."""
    return F.concat(_said(n), F.when(n >= cap, "+").otherwise(""))
