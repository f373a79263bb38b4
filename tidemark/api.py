"""The engine's functions over one set of stored tables: queries, searches, updates, notes, triggers, heartbeats."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import model
from tidemark.operators import lookup, notes, reactions, state
from tidemark.operators.filters import EventFilter
from tidemark.operators.plugins import Hooks
from tidemark.plans.query import EventQuery, SavedSearches, page, total, update_by_search
from tidemark.sinks import scratch


class RollupCache:
    """Roll-ups by filter, kept for some seconds; the oldest goes where there are too many."""

    def __init__(self, seconds: float = 10.0, size: int = 100, now=time.monotonic):
        self.seconds, self.size, self.now, self._held = seconds, size, now, {}

    def get(self, key, make: Callable[[], DataFrame]) -> DataFrame:
        at = self.now()
        if key in self._held and at - self._held[key][0] < self.seconds:
            return self._held[key][1]
        self._held.pop(key, None)
        while len(self._held) >= self.size:
            self._held.pop(next(iter(self._held)))
        self._held[key] = at, make()
        return self._held[key][1]


@dataclass
class Engine:
    """Frames of the stored tables; a change gives a new frame, which `store` writes (by default it only takes its place here)."""

    summaries: DataFrame
    archive: DataFrame
    times: DataFrame | None = None
    beats: DataFrame | None = None
    types: dict[str, str] = field(default_factory=lambda: dict(model.DEFAULT_DETAILS))
    store: Callable[[str, DataFrame], DataFrame] = lambda name, df: df
    hooks: Hooks = field(default_factory=Hooks)
    clock: Callable[[], int] = lambda: int(time.time() * 1000)

    def __post_init__(self):
        self.searches, self.rollups = SavedSearches(scratch.cut), RollupCache()

    def _table(self, archive: bool) -> DataFrame:
        return self.archive if archive else self.summaries

    def list(self, q: EventQuery, archive: bool = False) -> tuple[DataFrame, DataFrame]:
        """(the page, its total and next offset)."""
        return page(self._table(archive), q, self.types), total(self._table(archive), q, self.types)

    def get(self, uuid: str) -> DataFrame:
        """An event of the summaries, or of the archive where they lack it."""
        one = self.summaries.sparkSession.createDataFrame([(uuid,)], "uuid string")
        return lookup.with_fallback(self.summaries, self.archive, one)

    def create_saved_search(self, q: EventQuery, archive: bool = False) -> str:
        return self.searches.create(self._table(archive), q)

    def search_page(self, name: str, offset: int = 0, limit: int = 1000) -> DataFrame:
        return self.searches.page(name, offset, limit)

    def delete_saved_search(self, name: str) -> bool:
        return self.searches.delete(name)

    def update(self, uuids: DataFrame, to: int, user: str | None = None) -> None:
        self.summaries = self.store("summaries", state.transition(self.summaries, uuids, to, self.clock(), user))
        self.hooks.updated("status", uuids, {"status": to, "user": user})

    def update_search(self, found: DataFrame, to: int, user: str | None = None, offset: int = 0, limit: int = 1000) -> tuple[int, bool]:
        """Changes a page of a frozen list of uuids; gives the next request's offset and whether there is one."""
        out, at, more = update_by_search(self.summaries, found, to, self.clock(), user, offset, limit)
        self.summaries = self.store("summaries", out)
        self.hooks.updated("status", found.orderBy("uuid").offset(offset).limit(limit), {"status": to, "user": user})
        return at, more

    def _either(self, uuid: str, change: Callable[[DataFrame], DataFrame]) -> None:
        live, old = notes.in_either(change, self.summaries, self.archive, uuid)
        if live is not self.summaries:
            self.summaries = self.store("summaries", live)
        if old is not self.archive:
            self.archive = self.store("archive", old)

    def add_note(self, uuid: str, message: str, user_uuid: str, user_name: str) -> None:
        at = self.clock()
        self._either(uuid, lambda df: notes.add_note(df, uuid, message, user_uuid, user_name, at))
        self.hooks.updated("note", self.summaries.sparkSession.createDataFrame([(uuid,)], "uuid string"), {"message": message})

    def update_details(self, uuid: str, new: Column) -> None:
        at = self.clock()
        self._either(uuid, lambda df: notes.update_details(df, uuid, new, at))
        self.hooks.updated("details", self.summaries.sparkSession.createDataFrame([(uuid,)], "uuid string"), {})

    def tag_severities(self, flt: EventFilter | None = None, requested: list[str] | None = None) -> DataFrame:
        key = flt, None if requested is None else tuple(requested)
        return self.rollups.get(key, lambda: scratch.cut(reactions.tag_severities(self.summaries, flt, requested, self.types)))

    def time_since(self, since_ms: int, n: int = 1000) -> DataFrame:
        return lookup.time_since(self.times, since_ms, n)

    def beat(self, new: DataFrame) -> None:
        self.beats = self.store("heartbeats", reactions.latest_beats(self.beats.unionByName(new) if self.beats is not None else new))

    def delete_beats(self, monitor: str, daemon: str | None = None) -> None:
        gone = (F.col("monitor") == monitor) & (F.lit(True) if daemon is None else F.col("daemon") == daemon)
        self.beats = self.store("heartbeats", self.beats.where(~gone))

    def model_changes(self, changes: DataFrame) -> None:
        """Elements that were ADDED (type, id, uuid, title, parent_uuid) or REMOVED (uuid)."""
        at = self.clock()
        out = state.reidentify(self.summaries, changes.where("change = 'ADDED'"), at)
        self.summaries = self.store("summaries", state.deidentify(out, changes.where("change = 'REMOVED'"), at))

    def age(self, interval_ms: int, max_severity: int, inclusive: bool = False, limit: int | None = None) -> None:
        self.summaries = self.store("summaries", state.age(self.summaries, self.clock(), interval_ms, max_severity, inclusive, limit))

    def archive_old(self, interval_ms: int, limit: int | None = None) -> None:
        live, old = state.archive_split(self.summaries, self.clock(), interval_ms, limit)
        kept = [c for c in self.archive.columns if c in old.columns]
        self.archive = self.store("archive", self.archive.unionByName(old.select(*kept), allowMissingColumns=True))
        self.summaries = self.store("summaries", live)


def rebuild(source: DataFrame, write: Callable[[DataFrame, str], None], done: set[str], save: Callable[[str], None]) -> None:
    """Writes a table anew in 16 parts by the first digit of uuid; parts that are done are left out, so a rebuild can go on where it ended."""
    for digit in "0123456789abcdef":
        if digit not in done:
            write(source.where(F.substring(F.lower("uuid"), 1, 1) == digit), digit)
            save(digit)
