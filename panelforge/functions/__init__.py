"""Column functions of identifiers, texts, calendars and scaling; all are built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean days of a month, sessions of a month, months of a year.
DAYS_PER_MONTH, SESSIONS_PER_MONTH, MONTHS_PER_YEAR = 30.4375, 21, 12


def strict_map(x: Column, values: Mapping[str, object]) -> Column:
    """The value of x in the mapping; a null stays null, an unknown x is an error."""
    table = F.create_map(*(F.lit(p) for kv in values.items() for p in kv))
    unknown = F.raise_error(F.concat(F.lit("unknown value: "), x.cast("string")))
    return F.when(x.isNull(), None).otherwise(F.coalesce(F.try_element_at(table, x), unknown))


def vendor_symbol(code: Column) -> Column:
    """A ticker in the form with hyphens, without its exchange."""
    return F.translate(F.regexp_replace(F.upper(F.trim(code)), r"\.US$", ""), "./", "--")


def without_old_suffix(code: Column) -> Column:
    """A code without the mark of a code that was given to another company later."""
    return F.regexp_replace(code, r"(?i)_old\d*$", "")


def ten_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 10, "0")


def significant(x: Column, digits: int) -> Column:
    """x rounded to a number of significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def typed_cell(text: Column) -> Column:
    """A cell of a CSV as (kind, number): empty, a number, or text."""
    number = F.trim(text).try_cast("double")
    kind = F.when(text.isNull() | (F.trim(text) == ""), "empty").when(number.isNotNull(), "number").otherwise("text")
    return F.struct(kind.alias("kind"), number.alias("number"))


def staleness_days(months: int) -> int:
    """The age in days at which a fact of so many months is stale."""
    return round(months * DAYS_PER_MONTH)


def annual(monthly: Column) -> Column:
    """A monthly deviation as a yearly one."""
    return monthly * F.sqrt(F.lit(float(MONTHS_PER_YEAR)))


def monthly_variance(daily: Column) -> Column:
    """A daily variance over the forecast horizon."""
    return daily * SESSIONS_PER_MONTH
