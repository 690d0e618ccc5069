"""Days, clock windows and working days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_target(day: Column, cut_over: str, target: int, before: int) -> Column:
    """``target`` for ISO days from ``cut_over`` on, ``before`` for earlier ones and for what is no day."""
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & (day >= cut_over), target).otherwise(F.least(F.lit(target), F.lit(before)))


def _seconds(clock: str) -> int:
    hour, minute = clock.split(":")
    return int(hour) * 3600 + int(minute) * 60


def clock_window(at: Column, windows: list[tuple[str, str]], buffer_minutes: int = 3) -> tuple[Column, Column]:
    """(the window a time lies in, '' for none; whole minutes left), windows closing ``buffer_minutes`` before their end."""
    now = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    opened, left = F.lit(""), F.lit(0)
    for begin, end in reversed(windows):
        last = _seconds(end) - 60 * buffer_minutes
        inside = now.between(_seconds(begin), last)
        opened = F.when(inside, f"{begin}-{end}").otherwise(opened)
        left = F.when(inside, F.floor((F.lit(last) - now) / 60)).otherwise(left)
    return opened, left.cast("int")


def next_workday(day: Column) -> Column:
    """The next Monday to Friday after a date."""
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))
