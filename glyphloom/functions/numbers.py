"""Labels of digit runs: phones, years, dates, numbers. Native CASE expressions, first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers of mobile phones, years taken for dates, and the chances of a label and of a plain number.
MOBILE = r"^1(3[0-9]|4[5-9]|5[0-35-9]|6[2567]|7[0-8]|8[0-9]|9[0-35-9])[0-9]{8}$"
FIRST_YEAR, LAST_YEAR = 1950, 2015
CHANCES = {"yyyymm": (0.20, 0.12), "yyyymm_nopad": (0.20, 0.12), "mmdd": (0.20, 0.12), "mmdd_nopad": (0.20, 0.12), "yymmdd_nopad": (0.25, 0.20), "yyyymmdd_nopad": (0.25, 0.15)}


def _date(year: Column, month: Column, day: Column) -> Column:
    """Whether three digit strings are a date."""
    return F.coalesce(F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), F.lit(0), F.lit(0), F.lit(0)).isNotNull(), F.lit(False))


def _in_years(year: Column) -> Column:
    return year.cast("int").between(FIRST_YEAR, LAST_YEAR)


def _full_year(yy: Column) -> Column:
    """00-15 are 20yy, 50-99 are 19yy; others no year."""
    n = yy.cast("int")
    return F.when(n <= LAST_YEAR % 100, F.lit(2000) + n).when(n >= FIRST_YEAR % 100, F.lit(1900) + n).cast("string")


def _month_day(year: Column, rest: Column, size: int) -> Column:
    """Whether the rest, of a known size, splits into a month and a day of one or two digits each."""
    found = F.lit(False)
    for m in (1, 2):
        if 1 <= size - m <= 2:
            found = found | _date(year, F.substring(rest, 1, m), F.substring(rest, m + 1, size - m))
    return found


def number_label(v: Column) -> Column:
    """The label of a run of ASCII digits."""
    n = F.length(v)
    yy, yyyy = _full_year(F.substring(v, 1, 2)), F.substring(v, 1, 4)
    leap = F.lit("2000")

    def after(year, start, size):
        return year.isNotNull() & _month_day(year, F.substring(v, start, size), size)

    return (
        F.when(v.rlike(MOBILE), "cn_mobile")
        .when((n == 4) & _in_years(v), "year")
        .when((n == 6) & yy.isNotNull() & _date(yy, F.substring(v, 3, 2), F.substring(v, 5, 2)), "yymmdd")
        .when((n == 8) & _in_years(yyyy) & _date(yyyy, F.substring(v, 5, 2), F.substring(v, 7, 2)), "yyyymmdd")
        .when((n == 6) & _in_years(yyyy) & F.substring(v, 5, 2).cast("int").between(1, 12), "yyyymm")
        .when((n == 5) & _in_years(yyyy) & F.substring(v, 5, 1).cast("int").between(1, 9), "yyyymm_nopad")
        .when((n == 4) & _date(leap, F.substring(v, 1, 2), F.substring(v, 3, 2)), "mmdd")
        .when((n == 3) & _month_day(leap, v, 3), "mmdd_nopad")
        .when((n == 2) & _month_day(leap, v, 2), "mmdd_nopad")
        .when(((n == 4) & after(yy, 3, 2)) | ((n == 5) & after(yy, 3, 3)) | ((n == 6) & after(yy, 3, 4)), "yymmdd_nopad")
        .when(_in_years(yyyy) & (((n == 6) & after(yyyy, 5, 2)) | ((n == 7) & after(yyyy, 5, 3)) | ((n == 8) & after(yyyy, 5, 4))), "yyyymmdd_nopad")
        .otherwise(F.concat(F.lit("number"), n.cast("string")))
    )


def label_text(v: str) -> list[tuple[str, float]]:
    """The labels of a run of digits with their chances (1 for a single one), in plain Python, for the parser."""
    from datetime import date

    def real(y: int, m: str, d: str) -> bool:
        try:
            date(y, int(m), int(d))
            return True
        except ValueError:
            return False

    def splits(y: int | None, rest: str) -> bool:
        return y is not None and any(1 <= len(rest) - m <= 2 and real(y, rest[:m], rest[m:]) for m in (1, 2))

    import re

    n, plain = len(v), f"number{len(v)}"
    yyyy = int(v[:4]) if n >= 4 and FIRST_YEAR <= int(v[:4]) <= LAST_YEAR else None
    two = int(v[:2]) if n >= 2 else -1
    yy = 2000 + two if 0 <= two <= LAST_YEAR % 100 else 1900 + two if two >= FIRST_YEAR % 100 else None
    if re.match(MOBILE, v):
        return [("cn_mobile", 1.0)]
    if n == 4 and yyyy:
        return [("year", 1.0)]
    if n == 6 and yy and real(yy, v[2:4], v[4:]):
        return [("yymmdd", 1.0)]
    if n == 8 and yyyy and real(yyyy, v[4:6], v[6:]):
        return [("yyyymmdd", 1.0)]
    found = None
    if yyyy and (n == 6 and 1 <= int(v[4:]) <= 12 or n == 5 and v[4] != "0"):
        found = "yyyymm" if n == 6 else "yyyymm_nopad"
    elif n == 4 and real(2000, v[:2], v[2:]):
        found = "mmdd"
    elif n in (2, 3) and splits(2000, v):
        found = "mmdd_nopad"
    elif 4 <= n <= 6 and splits(yy, v[2:]):
        found = "yymmdd_nopad"
    elif 6 <= n <= 8 and splits(yyyy, v[4:]):
        found = "yyyymmdd_nopad"
    return [(found, CHANCES[found][0]), (plain, CHANCES[found][1])] if found else [(plain, 1.0)]
