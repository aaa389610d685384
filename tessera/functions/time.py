"""Time: parsing, expressions that name a range, and calendar labels.

One canonical time column is used throughout: a timestamp in the session's zone (UTC). Ranges are half open.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\s*\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?\s*$"


def parse_iso(text: Column) -> Column:
    """A timestamp from ISO-8601 text; text without an offset is UTC, anything else is null."""
    return F.when(text.rlike(_ISO), F.try_to_timestamp(F.trim(text)))


def normalise_exif(text: Column, offset: Column | None = None) -> Column:
    """`Y:M:D h:m:s` as `Y-M-Dth:m:s` with the offset, if there is one."""
    iso = F.regexp_replace(text, r"^(\d{4}):(\d{2}):(\d{2})\s+", r"$1-$2-$3T")
    return iso if offset is None else F.concat(iso, F.coalesce(offset, F.lit("")))


def add_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_interval(secs=seconds.cast("decimal(18,6)"))


def part_of_day(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h < 5, "night").when(h < 8, "early morning").when(h < 12, "morning").when(h < 17, "afternoon").when(h < 20, "dusk").otherwise("evening")


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(m.between(3, 5), "spring").when(m.between(6, 8), "summer").when(m.between(9, 11), "autumn").otherwise("winter")


def calendar(ts: Column) -> list[Column]:
    """date, year, month, season and part_of_day of a time."""
    return [F.date_format(ts, "yyyy-MM-dd").alias("date"), F.year(ts).alias("year"), F.month(ts).alias("month"), season(ts).alias("season"), part_of_day(ts).alias("part_of_day")]


# --- expressions that name a range -----------------------------------------------------------------------------------
#
# An expression is read as fields (year, month, day), fields make moments, and a moment is the interval of its finest field.
# Relative expressions are intervals of months, counted from year 0, and are written as absolute ones.

_FIELDS = ("year", "month", "day")
# How fields and ranges are marked.
_UNITS = {"年": "year", "月": "month", "日": "day", "号": "day"}
_RANGE_MARKS = "~至到"
_TOKEN = re.compile(rf"(?P<number>\d+)\s*(?P<unit>[{''.join(_UNITS)}])?|(?P<mark>[-/.{_RANGE_MARKS}])|(?P<space>\s+)|(?P<other>.)", re.S)


@dataclass
class _Moment:
    """Fields from the year (or, in the second half of a range, the month) down."""

    fields: dict[str, int] = field(default_factory=dict)
    marked: bool = False  # whether some field has its unit written

    def next(self) -> str | None:
        finest = max((_FIELDS.index(f) for f in self.fields), default=-1)
        return _FIELDS[finest + 1] if finest < 2 else None

    def interval(self) -> tuple[datetime, datetime] | None:
        """[start, end) of the finest field; None for a date that the calendar doesn't have."""
        y, m, d = (self.fields.get(f) for f in _FIELDS)
        try:
            start = datetime(y, m or 1, d or 1)
        except (TypeError, ValueError):
            return None
        if d:
            return start, start + timedelta(days=1)
        after = y * 12 + (m or 12)
        return start, datetime(after // 12, after % 12 + 1, 1)


def _field_of(number: str, unit: str | None, moment: _Moment) -> str | None:
    """What a number stands for: what its unit says, a year if it looks like one, else the moment's next field."""
    year = len(number) == 4 and number[:2] in ("19", "20")
    if unit:
        named = _UNITS[unit]
        return named if (named == "year") == year and (year or len(number) <= 2) else None
    if year:
        return "year"
    return moment.next() if moment.fields and len(number) <= 2 else None


def _moments(text: str) -> tuple[list[_Moment], bool, bool]:
    """The moments of a text, whether the first two are the ends of a range, and whether anything else stands there."""
    out, now, mark, ranged, foreign = [], _Moment(), "", False, False
    for m in _TOKEN.finditer(text):
        if m["number"]:
            what = _field_of(m["number"], m["unit"], now)
            apart = mark in _RANGE_MARKS if mark else False
            apart = apart or mark == "-" and now.marked  # a hyphen joins bare numbers and parts written-out dates
            if what is None:
                foreign = True
            elif now.fields and (apart or what != now.next()):
                ranged |= len(out) == 0 and bool(mark) and (mark == "-" or mark in _RANGE_MARKS)
                out.append(now)
                now = _Moment({what: int(m["number"])}, bool(m["unit"]))
            else:
                now.fields[what] = int(m["number"])
                now.marked |= bool(m["unit"])
            mark = ""
        elif m["mark"]:
            mark = m["mark"]
        elif m["other"]:
            foreign = True
    return [*out, now] if now.fields else out, ranged, foreign


def parse_range(value: str | None) -> tuple[datetime, datetime] | None:
    """[start, end) of an absolute expression: a range of years, months or days, a day, a month, or a year.

    A day or month may stand among other words; a range or a year must be all there is. None if it is none of these.
    """
    found, ranged, foreign = _moments((value or "").strip())
    if len(found) == 2 and ranged and not foreign:
        ends = [found[0].interval(), _Moment(found[0].fields | found[1].fields if "year" not in found[1].fields else found[1].fields).interval()]
        return (ends[0][0], ends[1][1]) if all(ends) else None
    for moment in found:
        if "year" in moment.fields and (len(moment.fields) > 1 or not foreign and len(found) == 1):
            return moment.interval()
    return None


# Words of relative expressions.
_BASE = {"前年": -2, "去年": -1, "今年": 0}
_SEASON = {"春": (3, 5), "夏": (6, 8), "秋": (9, 11), "冬": (12, 14)}
_DIGITS = "一二三四五六七八九"
_RELATIVE = re.compile(rf"(?P<base>{'|'.join(_BASE)})\s*(?:(?P<month>\d{{1,2}}|[{_DIGITS}十]+)\s*月|(?P<season>[{''.join(_SEASON)}])[天季])?|(?P<back>上+)个月|(?P<span>近一年|[这近]两年)")


def _number(text: str) -> int:
    """Arabic, or Chinese up to 99."""
    if text.isdigit():
        return int(text)
    places = [_DIGITS.index(c) + 1 if c != "十" else 10 for c in text]
    ten = next((i for i, n in enumerate(places) if n == 10), None)
    return sum(places) if ten != 1 else places[0] * 10 + sum(places[2:])


def _written(first: int, last: int) -> str:
    """Months first to last (counted from year 0) as an absolute expression."""
    (y1, m1), (y2, m2) = divmod(first, 12), divmod(last, 12)
    if (m1, m2) == (0, 11):
        return f"{y1}年" if y1 == y2 else f"{y1}年-{y2}年"
    return f"{y1}年{m1 + 1}月" if first == last else f"{y1}年{m1 + 1}月-{y2}年{m2 + 1}月"


def _relative_months(m: re.Match, now: datetime) -> tuple[int, int]:
    this = now.year * 12 + now.month - 1
    if m["base"]:
        january = (now.year + _BASE[m["base"]]) * 12
        a, b = (_number(m["month"]),) * 2 if m["month"] else _SEASON[m["season"]] if m["season"] else (1, 12)
        return january + a - 1, january + b - 1
    if m["back"]:
        return this - len(m["back"]), this - len(m["back"])
    return (this - 12, this) if m["span"].endswith("一年") else ((now.year - 1) * 12, now.year * 12 + 11)


def resolve_relative(value: str | None, now: datetime) -> str | None:
    """A relative expression as an absolute one that parse_range reads; anything else comes back as it is."""
    text = (value or "").strip()
    if not text:
        return None
    if m := _RELATIVE.search(text):
        return _written(*_relative_months(m, now))
    return f"{text}年" if re.fullmatch(r"20\d{2}", text) else text


def extract_range(text: str | None, now: datetime) -> tuple[datetime, datetime] | None:
    """[start, end) of the time that a question names somewhere in its words, relative or absolute; None if it names none."""
    text = text or ""
    if m := _RELATIVE.search(text):
        return parse_range(_written(*_relative_months(m, now)))
    found, ranged, _ = _moments(text)
    if len(found) >= 2 and ranged and "year" in found[0].fields:
        ends = found[0].interval(), _Moment(found[0].fields | found[1].fields if "year" not in found[1].fields else found[1].fields).interval()
        return (ends[0][0], ends[1][1]) if all(ends) else None
    return next((i for x in found if "year" in x.fields and (i := x.interval())), None)
