"""Text and date functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import col

#: English month names with their numbers, and words that carry no content in a search.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
STOP_WORDS = [
    "a", "an", "the", "of", "in", "on", "at", "with", "and", "to", "from", "me", "my", "show", "find", "search", "for", "taken", "photo", "photos", "pic", "pics", "picture", "pictures", "image", "images", "all",
]


def tokens(q: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(col(q)), F.lit("[a-z0-9]+"), F.lit(0))


def quoted(term: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def has_word(text: str | Column, term: str | Column) -> Column:
    """Whether a term stands in a text between word borders, case ignored; an empty term never does."""
    text, term = F.lower(col(text)), F.lower(col(term))
    return (F.length(term) > 0) & F.coalesce(F.rlike(text, F.concat(F.lit("\\b"), quoted(term), F.lit("\\b"))), F.lit(False))


def city_part(place: str | Column) -> Column:
    """What stands before the first comma, trimmed and lower-cased."""
    return F.lower(F.trim(F.substring_index(col(place), ",", 1)))


def month_number(word: Column) -> Column:
    """The number of a month's lower-case name or short name; null for other words."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair]), word)


def month_of(q: str | Column) -> Column:
    """The number of the first whole-word month name of a text, short names but `sept` included; null without one."""
    names = "|".join(m for m in MONTHS if m != "sept")
    return month_number(F.regexp_extract(F.lower(col(q)), f"\\b({names})\\b", 1))


def year_of(q: str | Column) -> Column:
    """The first whole-word year of 19xx or 20xx; null without one."""
    return F.nullif(F.regexp_extract(col(q), "\\b((?:19|20)\\d\\d)\\b", 1), F.lit("")).cast("int")


def month_year(q: str | Column) -> Column:
    """Struct (year, month) of a text that names a month and a year; null without both."""
    year, month = year_of(q), month_of(q)
    return F.when(year.isNotNull() & month.isNotNull(), F.struct(year.alias("year"), month.alias("month")))


def naive_iso(s: str | Column) -> Column:
    """An ISO time without its zone (dropped, not converted); null for anything else."""
    bare = F.regexp_replace(F.replace(col(s), F.lit("T"), F.lit(" ")), "(Z|[+-]\\d\\d:?\\d\\d)$", "")
    return F.try_to_timestamp(F.when(bare.rlike("^\\d{4}-\\d\\d-\\d\\d( \\d\\d:\\d\\d(:\\d\\d(\\.\\d+)?)?)?$"), bare)).cast("timestamp_ntz")


def time_range(q: str | Column) -> Column:
    """Struct (lo, hi, granularity) of `YYYY`, `YYYY-MM`, `YYYY-MM-DD` or an ISO time (then within 6 hours, hi included); an error otherwise."""
    q = F.trim(col(q))
    at = lambda s: F.try_to_timestamp(s).cast("timestamp_ntz")
    hours = lambda n: F.expr(f"INTERVAL {n} HOURS")
    year, month, day, full = at(F.concat(q, F.lit("-01-01"))), at(F.concat(q, F.lit("-01"))), at(q), naive_iso(q)
    of = lambda lo, hi, g: F.struct(lo.cast("timestamp_ntz").alias("lo"), hi.cast("timestamp_ntz").alias("hi"), F.lit(g).alias("granularity"))
    return (F.when(q.rlike("^\\d{4}$") & year.isNotNull(), of(year, F.add_months(year, 12), "year"))
            .when(q.rlike("^\\d{4}-\\d\\d$") & month.isNotNull(), of(month, F.add_months(month, 1), "month"))
            .when(q.rlike("^\\d{4}-\\d\\d-\\d\\d$") & day.isNotNull(), of(day, F.date_add(day, 1), "day"))
            .when(full.isNotNull(), of(full - hours(6), full + hours(6), "datetime"))
            .otherwise(F.raise_error(F.concat(F.lit("not a time: "), F.coalesce(q, F.lit("null"))))))


def in_range(ts: str | Column, r: Column) -> Column:
    """Half-open for year, month and day; both ends for a time. Null never matches."""
    ts = col(ts)
    return (ts >= r["lo"]) & F.when(r["granularity"] == "datetime", ts <= r["hi"]).otherwise(ts < r["hi"])
