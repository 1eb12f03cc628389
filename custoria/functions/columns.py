"""Column expressions shared by the operators; all of them stay inside code generation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

# Sums of hundredths are kept as two long sums, of the part above these bits and of the part below.
_LOW_BITS = 16
_LOW_MASK = (1 << _LOW_BITS) - 1


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def cents(value: str | Column) -> Column:
    """An amount with two decimals as a whole number of hundredths."""
    return F.rint(_col(value) * 100).cast("bigint")


def sum_parts(hundredths: str | Column, name: str) -> list[Column]:
    """Two aggregates, `name`_high and `name`_low, that together are the exact sum.

    Sums of doubles depend on the order of the rows, one long overflows on very large tables, and
    decimal sums take several times as long, as they leave the fast aggregation buffers.
    """
    value = _col(hundredths)
    return [
        F.sum(F.shiftright(value, _LOW_BITS)).alias(f"{name}_high"),
        F.sum(value.bitwiseAND(_LOW_MASK)).alias(f"{name}_low"),
    ]


def add_parts(name: str) -> list[Column]:
    """The same two aggregates over rows that hold parts already."""
    return [F.sum(part).alias(part) for part in (f"{name}_high", f"{name}_low")]


def join_parts(high: str | Column, low: str | Column) -> Column:
    """Both parts as one decimal amount."""
    whole = _col(high).cast("decimal(20,0)") * (1 << _LOW_BITS) + _col(low).cast("decimal(20,0)")
    return whole.cast("decimal(36,0)") * F.lit(Decimal("0.01"))


def cents_sum(hundredths: str | Column) -> Column:
    """Exact sum of hundredths as a decimal amount."""
    return join_parts(*sum_parts(hundredths, "sum"))


def money_sum(value: str | Column) -> Column:
    """Exact sum of amounts as a decimal."""
    return cents_sum(cents(value))


def as_double(value: str | Column) -> Column:
    return _col(value).cast("double")


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """Quotient as double; null where the denominator is zero."""
    return F.try_divide(as_double(top), as_double(bottom))


def day_count(later: str | Column, earlier: str | Column) -> Column:
    """Whole days from `earlier` to `later`."""
    return F.datediff(_col(later), _col(earlier))


def month_of(date: str | Column) -> Column:
    """First day of the month."""
    return F.trunc(_col(date), "MM")


def month_label(date: str | Column) -> Column:
    return F.date_format(_col(date), "yyyy-MM")


def months_between(later: str | Column, earlier: str | Column) -> Column:
    """Difference of the calendar months as an integer, negative if `later` is before."""

    def ordinal(date):
        return F.year(date) * 12 + F.month(date)

    return (ordinal(_col(later)) - ordinal(_col(earlier))).cast("int")


def percent(value: str | Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", as_double(value) * 100)


def rupees(value: str | Column, digits: int = 2) -> Column:
    """Currency text with a thousands separator."""
    return F.concat(F.lit("Rs."), F.format_number(as_double(value), digits))


def thousands(value: str | Column) -> Column:
    return F.format_number(_col(value), 0)


def key_hash(seed: int, *keys: str) -> Column:
    """A 60-bit non-negative integer from the keys: the same on every run and partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(key).cast("string") for key in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


KEY_HASH_SPAN = 2**60
