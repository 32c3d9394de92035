"""Dates out of free text, addresses and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
NUMERIC = "([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})"
NAMED = "([0-9]{1,2})\\s+([A-Za-z]{3})[A-Za-z]*\\s+([0-9]{4})"


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))


def norm_date(c: Column) -> Column:
    """The first numeric date in the text, else "d Mon yyyy", as yyyy-mm-dd; "" if there is neither or the text is null.

    The calendar isn't checked: month 13 passes.
    """
    numeric = _iso(*(F.regexp_extract(c, NUMERIC, k) for k in (1, 2, 3)))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(c, NAMED, 2)))
    named = _iso(F.regexp_extract(c, NAMED, 3), month.cast("string"), F.regexp_extract(c, NAMED, 1))
    return F.when(c.rlike(NUMERIC), numeric).when(c.rlike(NAMED) & (month > 0), named).otherwise("")


def date_from_url(c: Column) -> Column:
    """yyyy-mm-dd from a path /20yy/m/d/ or, if there is none, /20yy-m-d; else ""."""
    slashes, dashes = "/(20[0-9]{2})/([0-9]{1,2})/([0-9]{1,2})(?:/|$)", "/(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})"
    parts = lambda p: _iso(*(F.regexp_extract(c, p, k) for k in (1, 2, 3)))
    return F.when(c.rlike(slashes), parts(slashes)).when(c.rlike(dashes), parts(dashes)).otherwise("")


def effective_date(label: Column, url: Column, run_date: Column) -> Column:
    """The item's own date if the calendar has it, else that of its address, else the day of the run.

    A date in the address that the calendar doesn't have gives null: such an item fails.
    """
    own, path = F.try_to_date(label, "yyyy-MM-dd"), date_from_url(url)
    return F.when(own.isNotNull(), own).when(path != "", F.try_to_date(path, "yyyy-MM-dd")).otherwise(run_date)
