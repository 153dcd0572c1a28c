"""Dates in texts: found, resolved against a day, classified."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPLICIT = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
YEAR = r"\b(?:19|20)[0-9]{2}\b"
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "sunday monday tuesday wednesday thursday friday saturday".split()
RELATIVE = r"\b(yesterday|today|tomorrow|last (week|month|year)|[0-9]+ (day|week|month|year)s? ago)\b"
PLANNED = r"\b(will|wants to|plans to|going to|scheduled)\b"


def explicit(text: Column) -> Column:
    """The days written as year-month-day; null for one that isn't in the calendar."""
    return F.transform(F.regexp_extract_all(text, F.lit(EXPLICIT), F.lit(0)), lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).cast("date"))


def month_years(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"\b(?:{'|'.join(MONTHS)}) (?:19|20)[0-9]{{2}}\b"), F.lit(0))


def years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(0)), lambda y: y.cast("int"))


def days_ago(said: Column) -> Column:
    """How many days "N units ago" is; a month counts 30, a year 365."""
    number = F.regexp_extract(F.lower(said), r"([0-9]+) (day|week|month|year)s? ago", 1)
    unit = F.regexp_extract(F.lower(said), r"([0-9]+) (day|week|month|year)s? ago", 2)
    return F.when(number != "", number.cast("int") * F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).otherwise(365))


def resolve(said: Column, day: Column) -> Column:
    """The day that a relative date means on a given day; null for what isn't one."""
    s = F.lower(F.trim(said))
    month, year = F.trunc(day, "month"), F.trunc(day, "year")
    out = F.when(s == "today", day).when(s == "yesterday", F.date_sub(day, 1)).when(s == "tomorrow", F.date_add(day, 1))
    out = out.when(s == "last week", F.date_sub(day, 7)).when(s == "next week", F.date_add(day, 7)).when(s == "this month", month)
    out = out.when(s == "last month", F.add_months(month, -1)).when(s == "next month", F.add_months(month, 1)).when(s == "this year", year)
    out = out.when(s == "last year", F.add_months(year, -12)).when(s == "next year", F.add_months(year, 12))
    out = out.when(s == "this weekend", F.date_add(day, (7 - F.dayofweek(day)) % 7))
    for number, name in enumerate(DAYS):
        back = (F.dayofweek(day) - 1 - number + 7) % 7
        ahead = (number - F.dayofweek(day) + 1 + 7) % 7
        out = out.when(s == f"last {name}", F.date_sub(day, F.when(back == 0, 7).otherwise(back))).when(s == f"next {name}", F.date_add(day, F.when(ahead == 0, 7).otherwise(ahead)))
    return out.otherwise(F.when(days_ago(s).isNotNull(), F.date_sub(day, days_ago(s))))


def intent(query: Column) -> Column:
    """What a question wants to know of time: when, how long, in which order, about a time, or nothing."""
    q = F.lower(query)
    when = q.startswith("when") | q.contains(" when ") | q.contains("what date") | q.contains("what day") | q.contains("what time")
    month = "|".join(m.lower() for m in MONTHS)
    about = rf"yesterday|today|(last|this) (week|month|year)|in ({month})|on ({'|'.join(DAYS)})| ago"
    return (
        F.when(when, "when").when(q.rlike("how long|how many (days|weeks|months|years)"), "duration").when(q.rlike("before or after|first or|earlier or later|which came first|in what order"), "order")
        .when(q.rlike(about) | q.rlike(EXPLICIT), "time").otherwise("none")
    )


def sortable(year: Column, month: Column, day: Column) -> Column:
    """A key in the order of time for a date of which parts may be unknown."""
    two = lambda c: F.lpad(F.coalesce(c, F.lit(0)).cast("string"), 2, "0")
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two(month), two(day))


def matches(at: Column, year: int | None, month: int | None, day: int | None) -> Column:
    out = F.lit(True)
    for part, value in ((F.year(at), year), (F.month(at), month), (F.dayofmonth(at), day)):
        if value is not None:
            out = out & (part == value)
    return out


def time_class(day: Column, today: Column) -> Column:
    return F.when(day > today, "future").when(day == today, "present").otherwise("past")


def fact_kind(sentence: Column) -> Column:
    """planned, occurred (a day is named) or historical (a year is); null for a sentence without time."""
    return F.when(F.lower(sentence).rlike(PLANNED), "planned").when(sentence.rlike(EXPLICIT), "occurred").when(sentence.rlike(r"\b(19|20)[0-9]{2}\b"), "historical")
