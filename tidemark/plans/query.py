"""Queries over summaries: filter, exclusion, sort, page; saved searches."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ip
from tidemark.operators import state
from tidemark.operators.filters import EventFilter, condition

MAX_PAGE = 1000
CASELESS = {"element_identifier", "element_title", "element_sub_identifier", "element_sub_title", "summary"}


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False
    kind: str = "plain"  # or ip: version 4 before version 6


@dataclass(frozen=True)
class EventQuery:
    filter: EventFilter = EventFilter()
    exclusion: EventFilter | None = None
    sort: tuple[Sort, ...] = ()
    offset: int = 0
    limit: int = MAX_PAGE


def order(sorts: tuple[Sort, ...], tiebreak: str = "uuid") -> list[Column]:
    out = []
    for s in sorts:
        c = F.col(s.field)
        keys = [ip.ip_type(c), ip.canonical_column(c)] if s.kind == "ip" else [
            F.lower(c) if s.field in CASELESS else F.concat(F.lower(c), F.lit("/")) if s.field == "event_class" else c
        ]
        out += [k.desc_nulls_last() if s.descending else k.asc_nulls_first() for k in keys]
    return [*out, F.col(tiebreak).asc()]


def matching(summaries: DataFrame, q: EventQuery, types: dict[str, str] | None = None) -> DataFrame:
    df = summaries.where(condition(q.filter, types))
    return df.where(~condition(q.exclusion, types)) if q.exclusion else df


def page(summaries: DataFrame, q: EventQuery, types: dict[str, str] | None = None) -> DataFrame:
    """One page. Sort and limit plan as a top-k."""
    if q.limit < 0:
        raise ValueError("a limit must not be negative")
    out = matching(summaries, q, types).orderBy(*order(q.sort))
    return out.offset(max(0, q.offset)).limit(min(q.limit, MAX_PAGE)) if q.offset > 0 else out.limit(min(q.limit, MAX_PAGE))


def total(summaries: DataFrame, q: EventQuery, types: dict[str, str] | None = None) -> DataFrame:
    """total and next_offset (null on the last page)."""
    end = max(0, q.offset) + min(q.limit, MAX_PAGE)
    n = F.count("*")
    return matching(summaries, q, types).agg(n.alias("total"), F.when(n > end, F.lit(end)).alias("next_offset"))


class SavedSearches:
    """Frozen result lists with a sliding timeout; each is a table in the shared folder."""

    def __init__(self, write, timeout_s: float = 300.0, now=time.monotonic, drop=None):
        """write makes a frame into a table and gives it back; drop deletes that table."""
        self._write, self._timeout, self._now, self._held, self._drop = write, timeout_s, now, {}, drop

    def create(self, summaries: DataFrame, q: EventQuery) -> str:
        name = str(uuid.uuid4())
        self._held[name] = (self._write(matching(summaries, q)), q, self._now() + self._timeout)
        return name

    def page(self, name: str, offset: int, limit: int) -> DataFrame:
        df, q, until = self._held.get(name, (None, None, 0))
        if self._now() > until:
            self.delete(name)
            raise KeyError(f"no saved search {name}")
        self._held[name] = (df, q, self._now() + self._timeout)
        return page(df, EventQuery(sort=q.sort, offset=offset, limit=limit))

    def delete(self, name: str) -> bool:
        held = self._held.pop(name, None)
        if held is not None and self._drop is not None:
            self._drop(held[0])
        return held is not None


def update_by_search(
    summaries: DataFrame, found: DataFrame, to: int, now_ms: int, user: str | None = None, offset: int = 0, limit: int = MAX_PAGE
) -> tuple[DataFrame, int, bool]:
    """(summaries after a page of a frozen result list (uuid) changed status, where the next request goes on, whether there is one)."""
    page_ = found.orderBy("uuid").offset(offset).limit(limit)
    return state.transition(
        summaries, page_, to, now_ms, user
    ), offset + limit, found.orderBy("uuid").offset(offset + limit).limit(1).count() > 0
