"""Query specifications: what a structured question asks for, as frozen values on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from tessera.functions.time import parse_range, resolve_relative

HARD, SEMANTIC = "hard", "semantic"
MEDIA = ("image", "video", "audio", "document")
OPERATIONS = ("count", "exists", "first", "last", "date", "date_range", "group_count", "distinct", "list")
GROUPS = ("month", "year", "date", "media", "place")
#: Dimensions that only what an asset shows can answer.
SHOWN = ("object", "clothing", "activity", "ocr", "scene")


@dataclass(frozen=True)
class Constraint:
    """One condition of a query; a negated one excludes what matches."""

    dimension: str
    value: object
    strictness: str = SEMANTIC
    negated: bool = False

    @property
    def key(self) -> str:
        return f"{self.dimension}:{self.value}"


@dataclass(frozen=True)
class QuerySpec:
    scope_id: str | None = None
    media: tuple[str, ...] = ()
    not_media: tuple[str, ...] = ()
    start: datetime | None = None
    end: datetime | None = None
    place: str | None = None
    entity_ids: tuple[str, ...] = ()
    operation: str = "count"
    group_by: str = "month"
    constraints: tuple[Constraint, ...] = ()


def day_end(value: str | datetime | None) -> datetime | None:
    """The end of a range: a date without a time takes in all of that day."""
    if value is None or isinstance(value, datetime):
        return value
    moment = datetime.fromisoformat(value)
    return moment + timedelta(days=1) if len(value) == 10 else moment


def spec_from_filters(filters: dict, now: datetime) -> QuerySpec:
    """A specification from the filters of a question; only known keys, media and operations pass."""
    unknown = set(filters) - {"scope_id", "media", "not_media", "time", "start", "end", "place", "entity_ids", "operation", "group_by"}
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    span = parse_range(resolve_relative(filters.get("time"), now)) if filters.get("time") else None
    start = span[0] if span else datetime.fromisoformat(filters["start"]) if filters.get("start") else None
    operation, group = filters.get("operation", "count"), filters.get("group_by", "month")
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation: {operation}")
    return QuerySpec(
        scope_id=filters.get("scope_id") or None,
        media=tuple(m for m in filters.get("media", ()) if m in MEDIA),
        not_media=tuple(m for m in filters.get("not_media", ()) if m in MEDIA),
        start=start,
        end=span[1] if span else day_end(filters.get("end")),
        place=filters.get("place") or None,
        entity_ids=tuple(filters.get("entity_ids", ())),
        operation=operation,
        group_by=group if group in GROUPS else "month",
    )


def strategy(spec: QuerySpec) -> str:
    """`structured` where columns alone answer, `hybrid` where something shown has to be found."""
    shown = any(c.dimension in SHOWN for c in spec.constraints)
    return "hybrid" if shown or spec.operation == "list" and spec.constraints else "structured"
