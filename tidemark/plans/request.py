"""Requests as query strings: filters, exclusions, sorts and pages."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from tidemark import model
from tidemark.operators.filters import EventFilter, Range, parse_count
from tidemark.plans.query import MAX_PAGE, EventQuery, Sort

#: The names of parameters that are lists of values, and their columns.
WILDCARDS = {"fingerprint": "fingerprint", "uuid": "uuid", "current_user": "user_name"}
IDENTIFIERS = {"element_identifier": "element_identifier", "element_sub_identifier": "element_sub_identifier"}
TEXTS = {"event_summary": "summary"}
TIMES = ("first_seen", "last_seen", "status_change", "update_time")

Params = dict[str, list[str]]


def parse_time(text: str) -> int:
    """Milliseconds of an ISO-8601 time in UTC, with or without milliseconds."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,3})?Z", text):
        raise ValueError(f"not a time: {text}")
    whole, _, fraction = text[:-1].partition(".")
    seconds = datetime.strptime(whole, "%Y-%m-%dT%H:%M:%S").replace(tzinfo=UTC).timestamp()
    return int(seconds) * 1000 + int(fraction or 0)


def parse_times(text: str) -> Range:
    """A time, from which on, or a time / time range."""
    start, slash, end = text.partition("/")
    out = parse_time(start), parse_time(end) if slash else None
    if out[1] is not None and out[0] > out[1]:
        raise ValueError(f"{start} is after {end}")
    return out


def event_filter(params: Params, exclusion: bool = False) -> EventFilter:
    """The filter of a request's parameters; those of its exclusion begin with ex_."""
    get = lambda name: tuple(dict.fromkeys(params.get(("ex_" if exclusion else "") + name, ())))
    first = lambda name: next(iter(get(name)), None)
    columns = lambda names: tuple((col, get(name)) for name, col in names.items() if get(name))
    tags = get("tag_uuids")
    op = (first("tag_uuids_op") or "OR").upper()
    if op not in ("AND", "OR"):
        raise ValueError(f"no such operator: {op}")
    count = parse_count(first("count"))
    return EventFilter(
        severity=tuple(model.name_of(model.SEVERITY_NAMES, v) for v in get("severity")),
        status=tuple(model.name_of(model.STATUS_NAMES, v) for v in get("status")),
        count=(count,) if count else (), **{t: (parse_times(first(t)),) for t in TIMES if first(t)}, event_class=get("event_class"),
        wildcards=columns(WILDCARDS), identifiers=columns(IDENTIFIERS), texts=columns(TEXTS), tags=((op, tags),) if tags else (),
    )


def event_query(params: Params) -> EventQuery:
    """The query of a request's parameters. Sorts are FIELD or FIELD,ASCENDING or FIELD,DESCENDING."""
    number = lambda name, default: int(next(iter(params.get(name, ())), default))
    limit, offset = number("limit", MAX_PAGE), number("offset", 0)
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    sorts = []
    for text in params.get("sort", ()):
        name, _, direction = text.partition(",")
        if direction not in ("", "ASCENDING", "DESCENDING"):
            raise ValueError(f"no such direction: {direction}")
        sorts.append(Sort({"count": "event_count"}.get(name.lower(), name.lower()), direction == "DESCENDING"))
    exclusion = event_filter(params, exclusion=True)
    return EventQuery(event_filter(params), None if exclusion == EventFilter() else exclusion, tuple(sorts), offset, limit)
