"""Dates of tasks: due, overdue, and the next of a series; loosely written states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overdue(due: Column, now: Column) -> Column:
    return due < now


def due_today(due: Column, now: Column) -> Column:
    return F.to_date(due) == F.to_date(now)


def next_daily(day: Column, every: int) -> Column:
    return F.date_add(day, every)


def next_weekday(day: Column, days: list[int]) -> Column:
    """The first of the given weekdays (0 is Sunday) after `day`; in a week if it is that day itself."""
    today = F.dayofweek(day) - 1
    ahead = [F.when((F.lit(d) - today + 7) % 7 == 0, 7).otherwise((F.lit(d) - today + 7) % 7) for d in days]
    return F.date_add(day, F.least(*ahead) if len(ahead) > 1 else ahead[0])


def next_monthly(day: Column, wanted: Column) -> Column:
    """A day of the next month, at most the 28th."""
    start = F.add_months(F.trunc(day, "month"), 1)
    return F.date_add(start, F.least(wanted, F.lit(28)) - 1)


# How states may be written.
STATES = {
    "Backlog": ("backlog", "someday", "maybe"), "Todo": ("todo", "next", "ready"), "InProgress": ("in_progress", "inprogress", "active", "doing"), "Blocked": ("blocked", "waiting", "waiting_for"),
    "Done": ("done", "completed", "complete"), "Cancelled": ("cancelled", "canceled", "wont_do"),
}


def loose_status(said: Column) -> Column:
    out = F.lit(None).cast("string")
    for state, names in STATES.items():
        out = F.when(F.lower(said).isin(*names), state).otherwise(out)
    return out
