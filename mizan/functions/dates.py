"""Dates in free text and in written forms, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The written forms, tried in this order.
FORMATS = ("yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d", "d MMMM yyyy", "d MMM yyyy")
SENTINEL = "9999-12-31"


def normalize_date(c: Column) -> Column:
    """A written date as yyyy-MM-dd; a bare year is its first day, a month its first; else null (DAT-1)."""
    t = F.trim(c)
    day = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS])
    month = F.coalesce(*[F.try_to_timestamp(F.concat(F.lit("1 "), t), F.lit(f)) for f in ("d MMMM yyyy", "d MMM yyyy")])
    year = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01")))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), year, F.date_format(month, "yyyy-MM-dd"))


def dates_in(c: Column) -> Column:
    """Distinct dates of a text as yyyy-MM-dd: ISO forms, then D/M/Y, then bare years 1800 to 2199 that
    lie in none of those, as their last day (DAT-2)."""
    t = F.coalesce(c, F.lit(""))
    iso_form, dmy_form = r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)", r"(?<!\d)(\d{1,2}/\d{1,2}/\d{4})(?!\d)"
    iso = F.regexp_extract_all(t, F.lit(iso_form), F.lit(1))
    dmy = F.transform(
        F.regexp_extract_all(t, F.lit(dmy_form), F.lit(1)),
        lambda x: F.concat_ws("-", F.split_part(x, F.lit("/"), F.lit(3)), F.lpad(F.split_part(x, F.lit("/"), F.lit(2)), 2, "0"), F.lpad(F.split_part(x, F.lit("/"), F.lit(1)), 2, "0")),
    )
    left = F.regexp_replace(F.regexp_replace(t, iso_form, " "), dmy_form, " ")
    years = F.transform(F.regexp_extract_all(left, F.lit(r"(?<!\d)((?:1[89]|2[01])\d{2})(?!\d)"), F.lit(1)), lambda y: F.concat(y, F.lit("-12-31")))
    return F.array_distinct(F.concat(iso, dmy, years))


def target_date(dates: Column) -> Column:
    """The latest date, or the sentinel (DAT-3)."""
    return F.coalesce(F.array_max(dates), F.lit(SENTINEL))
