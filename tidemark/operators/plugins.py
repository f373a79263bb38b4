"""Plugins: transforms of event frames, run in the order of their dependencies."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Plugin:
    name: str
    run: Callable[[DataFrame, dict], DataFrame]
    needs: tuple[str, ...] = ()
    properties: dict = field(default_factory=dict)


def in_order(plugins: Iterable[Plugin], disabled: Iterable[str] = ()) -> list[Plugin]:
    """Dependencies first, names in order where that leaves a choice; a missing one or a cycle is an error."""
    off = set(disabled)
    by_name = {p.name: p for p in sorted(plugins, key=lambda p: p.name) if p.name not in off}
    for p in by_name.values():
        if gone := [n for n in p.needs if n not in by_name]:
            raise ValueError(f"{p.name} needs {', '.join(gone)}")
    try:
        return [by_name[n] for n in TopologicalSorter({n: p.needs for n, p in by_name.items()}).static_order()]
    except CycleError as e:
        raise ValueError(f"plugins need each other: {e.args[1]}") from e


def apply(events: DataFrame, plugins: Iterable[Plugin], disabled: Iterable[str] = ()) -> DataFrame:
    for p in in_order(plugins, disabled):
        events = p.run(events, p.properties)
    return events


@dataclass
class Hooks:
    """Functions that are called with what became of a batch; each kind runs in the order in which they were added.

    post_create: (occurrences, summaries). post_index: (start, prepare, run, end), called in that order for each batch with (batch). update: (kind, uuids, change),
    where kind is status, note or details. A hook that raises stops the batch, which is then run again.
    """

    post_create: list[Callable[[DataFrame, DataFrame], None]] = field(default_factory=list)
    post_index: list[tuple[Callable[[DataFrame], None] | None, ...]] = field(default_factory=list)
    update: list[Callable[[str, DataFrame, dict], None]] = field(default_factory=list)

    def created(self, occurrences: DataFrame, summaries: DataFrame) -> None:
        for f in self.post_create:
            f(occurrences, summaries)

    def indexed(self, batch: DataFrame) -> None:
        for step in range(4):
            for hook in self.post_index:
                if step < len(hook) and hook[step] is not None:
                    hook[step](batch)

    def updated(self, kind: str, uuids: DataFrame, change: dict) -> None:
        for f in self.update:
            f(kind, uuids, change)
