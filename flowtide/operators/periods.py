"""Periods of whole UTC days, splits, and annotation intervals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import first_match, instant

UNASSIGNED = "unassigned"


class SplitError(ValueError):
    """The periods can't be used."""


@dataclass(frozen=True)
class Period:
    """[start, end) in whole days."""

    name: str
    start: date
    end: date

    def where(self, ts: Column, ntz: bool = False) -> Column:
        """Rows whose instant lies in the period."""
        lo, hi = (instant(datetime.combine(d, time()), ntz) for d in (self.start, self.end))
        return (ts >= lo) & (ts < hi)

    def where_date(self, day: Column) -> Column:
        """The same on a date column, which prunes partitions."""
        return (day >= F.lit(self.start)) & (day < F.lit(self.end))


@dataclass(frozen=True)
class Annotation:
    """An interval [start, end) that gives context; never a label."""

    name: str
    start: datetime
    end: datetime
    source: str = ""
    notes: str = ""
    confidence: str = ""


def period_label(periods: Sequence[Period], ts: Column, ntz: bool = False) -> Column:
    """The name of the period that holds the instant."""
    return first_match([(p.where(ts, ntz), p.name) for p in periods], UNASSIGNED)


def check_periods(periods: Sequence[Period]) -> list[Period]:
    """Refuses empty, overlapping or unordered periods."""
    for p in periods:
        if p.start >= p.end:
            raise SplitError(f"{p.name}: empty period")
    for a, b in zip(periods, periods[1:], strict=False):
        if b.start < a.end:
            raise SplitError(f"{b.name} starts before {a.name} ends")
    return list(periods)


def split_by_fractions(days: Sequence[date], fractions: dict[str, float]) -> list[Period]:
    """Chronological periods with given shares of the days that have data; the last takes what is left of a full sum."""
    days = sorted(set(days))
    if not days or sum(fractions.values()) > 1 + 1e-9 or min(fractions.values()) < 0:
        raise SplitError("fractions must be positive, sum to at most 1, and there must be days")
    out, used, share = [], 0, 0.0
    for name, f in fractions.items():
        share += f
        upto = min(len(days), round(share * len(days)))
        if upto > used:
            out.append(Period(name, days[used], days[upto - 1] + timedelta(days=1)))
        elif name == "train":
            raise SplitError("train has no day")
        used = upto
    return check_periods(out)


def _overlaps(start: Column, end: Column, a: Annotation, hours: float, ntz: bool) -> Column:
    pad = timedelta(hours=hours)
    return (start < instant(a.end + pad, ntz)) & (end > instant(a.start - pad, ntz))


def annotation_category(start: Column, end: Column, annotations: Sequence[Annotation], buffer_hours: float, ntz: bool = False) -> Column:
    """``inside`` an interval, within its ``buffer``, or ``outside``."""
    arms = [(_overlaps(start, end, a, 0, ntz), "inside") for a in annotations] + [(_overlaps(start, end, a, buffer_hours, ntz), "buffer") for a in annotations]
    return first_match(arms, "outside")


def day_category(day: Column, annotations: Sequence[Annotation], buffer_hours: float, ntz: bool = False) -> Column:
    """The category of a whole day."""
    at = lambda d: d.cast("timestamp_ntz" if ntz else "timestamp")
    return annotation_category(at(day), at(F.date_add(day, 1)), annotations, buffer_hours, ntz)


def annotation_names(start: Column, end: Column, annotations: Sequence[Annotation], buffer_hours: float, ntz: bool = False) -> Column:
    """Names of the intervals that a row touches, buffers included, joined by commas; null if none."""
    names = [F.when(_overlaps(start, end, a, buffer_hours, ntz), F.lit(a.name)) for a in annotations]
    return F.nullif(F.concat_ws(",", *names), F.lit("")) if names else F.lit(None).cast("string")


def overlapping(annotations: Sequence[Annotation], start: datetime, end: datetime, buffer_hours: float = 0) -> list[Annotation]:
    """The intervals that touch [start, end)."""
    pad = timedelta(hours=buffer_hours)
    return [a for a in annotations if a.start - pad < end and a.end + pad > start]
