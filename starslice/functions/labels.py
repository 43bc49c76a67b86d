"""Display formats for numbers, ranks and seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "–"


def grouped(v: Column) -> Column:
    """Whole number with thousands separators; rounded half up first."""
    return F.format_number(F.round(v.cast("double"), 0), 0)


def fixed(v: Column, digits: int) -> Column:
    return F.when(v.isNotNull(), F.format_string(f"%.{digits}f", F.round(v.cast("double"), digits)))


def percent(v: Column, digits: int = 1) -> Column:
    return F.concat(fixed(v.cast("double") * 100, digits), F.lit("%"))


def plus(v: Column, text: Column) -> Column:
    """A leading plus sign for positive values."""
    return F.concat(F.when(v > 0, "+").otherwise(""), text)


def metric(v: Column, fmt: str) -> Column:
    """A metric value in its registered format; an undefined value shows a dash."""
    shown = {
        "int": grouped(v), "dec1": fixed(v, 1), "dec2": fixed(v, 2), "pct": percent(v), "signed_pct": plus(v, percent(v)),
        "signed_int": plus(v, grouped(v)), "z": plus(v, F.concat(fixed(v, 2), F.lit("σ"))),
    }[fmt]
    return F.coalesce(shown, F.lit(DASH))


def ordinal(n: Column) -> Column:
    tens, ones = n % 100, n % 10
    tail = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def season_label(year: Column, split_year: bool = True) -> Column:
    """``2015-16`` for a season that spans two calendar years, else the year."""
    if not split_year:
        return year.cast("string")
    return F.concat(year.cast("string"), F.lit("-"), F.lpad((F.pmod(year + 1, F.lit(100))).cast("string"), 2, "0"))


def short_year(year: Column, many: bool) -> Column:
    return F.concat(F.lit("'"), F.substring(year.cast("string"), 3, 2)) if many else year.cast("string")
