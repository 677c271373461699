"""Column functions on dates and years as the older pipeline reads them: from file name and text together, by form and by context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions import columns as C

_REST = "[.\\-/年](?:0?[1-9]|1[0-2])[.\\-/月](?:0?[1-9]|[12][0-9]|3[01])"
_DAY = f"20[0-9]{{2}}{_REST}日?"


def _both(text: Column, file_name: Column) -> Column:
    return F.concat(F.coalesce(file_name, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))


def written_dates(text: Column) -> Column:
    """Full dates of a text as written, those of this century first, each once."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"({century}[0-9]{{2}}{_REST}日?)"), 1) for century in ("20", "19")]))


def first_date(text: Column, file_name: Column) -> Column:
    """The first full date of file name and text, empty without one."""
    return F.coalesce(F.get(written_dates(_both(text, file_name)), F.lit(0)), F.lit(""))


def signing_date(text: Column, file_name: Column) -> Column:
    """The date after a word for signing, else after 日期, else after Date, else the first date."""
    by = [rf"签[字署订][日期]*[：:]\s*({_DAY})", rf"日期[：:]\s*({_DAY})", rf"(?i)Date[：:]\s*(20[0-9]{{2}}{_REST.replace('年', '').replace('月', '')})"]
    return F.coalesce(*[C.group(text, p) for p in by], first_date(text, file_name))


def legacy_year(text: Column, file_name: Column, low: int = 2000, high: int = 2035) -> Column:
    """The year of the first full date if it lies within bounds, else the first year that does, else empty."""
    both = _both(text, file_name)
    within = lambda y: F.when(y.try_cast("int").between(low, high), y)
    every = F.filter(F.regexp_extract_all(both, F.lit("(?:19|20)[0-9]{2}"), 0), lambda y: y.cast("int").between(low, high))
    return F.coalesce(within(C.group(first_date(text, file_name), "((?:19|20)[0-9]{2})")), F.get(every, F.lit(0)), F.lit(""))


def path_year(path: Column, low: int = 2000, high: int = 2035) -> Column:
    """The first part of a path that is a year within bounds, else empty."""
    return F.coalesce(F.get(F.filter(F.split(path, "/"), lambda p: p.rlike("^(?:19|20)[0-9]{2}$") & p.try_cast("int").between(low, high)), F.lit(0)), F.lit(""))


def iso_or_text(text: Column) -> Column:
    """A written date as ISO, other texts as they are, missing ones empty."""
    return F.coalesce(C.parse_date(text).cast("string"), text, F.lit(""))
