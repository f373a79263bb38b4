"""The filter tree: an EventFilter becomes one Column, and Catalyst does the rest.

Values of one field are joined by OR (tags by their own operator), fields by the filter's operator,
and subfilters recurse. An empty filter matches everything. The missing value of an indexed numeric detail is
the least integer, so an open lower bound also matches rows without it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import ip, text

MISSING_INT = -(2**31)
MISSING_TEXT = "\u0007"
MAX_CLAUSES = 1024

Range = tuple[int | None, int | None]


@dataclass(frozen=True)
class DetailFilter:
    name: str
    values: tuple[str, ...]
    op: str = "OR"


@dataclass(frozen=True)
class EventFilter:
    severity: tuple[int, ...] = ()
    status: tuple[int, ...] = ()
    count: tuple[Range, ...] = ()
    first_seen: tuple[Range, ...] = ()
    last_seen: tuple[Range, ...] = ()
    status_change: tuple[Range, ...] = ()
    update_time: tuple[Range, ...] = ()
    wildcards: tuple[tuple[str, tuple[str, ...]], ...] = ()  # column, values: whole value, case-sensitive
    identifiers: tuple[tuple[str, tuple[str, ...]], ...] = ()
    texts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    event_class: tuple[str, ...] = ()
    tags: tuple[tuple[str, tuple[str, ...]], ...] = ()  # operator, tag uuids
    details: tuple[DetailFilter, ...] = ()
    subfilters: tuple[EventFilter, ...] = ()
    op: str = "AND"
    not_filter: EventFilter | None = field(default=None)


def parse_number(value: str) -> Range:
    """N, N:M, N: or :M."""
    low, colon, high = value.partition(":")
    if not colon:
        return int(low), int(low)
    out = (int(low) if low else None), (int(high) if high else None)
    if out == (None, None) or None not in out and out[0] > out[1]:
        raise ValueError(f"not a range: {value}")
    return out


def parse_count(value: str | None) -> Range | None:
    """The count syntax of query strings: >n, >=n, <n, <=n, =n, n, a:b."""
    if not value:
        return None
    for sign, make in (
        (">=", lambda n: (n, None)), ("<=", lambda n: (None, n)), (">", lambda n: (n + 1, None)), ("<", lambda n: (None, n - 1)),
        ("=", lambda n: (n, n))
    ):
        if value.startswith(sign):
            number = value[len(sign) :]
            if not number.isdigit():
                raise ValueError(f"not a count: {value}")
            return make(int(number))
    if value.startswith("-"):
        raise ValueError(f"not a count: {value}")
    return parse_number(value)


def merge_ranges(ranges: list[Range]) -> list[Range]:
    """Overlapping and adjacent integer ranges joined."""
    lo = float("-inf")
    out: list[list] = []
    for a, b in sorted(ranges, key=lambda r: lo if r[0] is None else r[0]):
        if out and (out[-1][1] is None or a is None or a <= out[-1][1] + 1):
            out[-1][1] = None if b is None or out[-1][1] is None else max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def _range(c: Column, r: Range) -> Column:
    a, b = r
    if a is None and b is None:
        return F.lit(True)
    if a is None:
        return c <= b
    return c >= a if b is None else c.between(a, b)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def _within(r: Range):
    return lambda v: _range(v, r)


def numeric_detail(values: Column, wanted: tuple[str, ...], op: str = "OR") -> Column:
    """values: array<int> of the row's detail; rows without it hold the sentinel."""
    held = F.when(F.coalesce(F.size(values), F.lit(0)) > 0, values).otherwise(F.array(F.lit(MISSING_INT)))
    ranges = [parse_number(v) for v in wanted]
    if op == "OR":
        ranges = merge_ranges(ranges)
    conds = [F.exists(held, _within(r)) for r in ranges]
    return any_of(conds) if op == "OR" else all_of(conds)


def has_tags(tags: Column, wanted: tuple[str, ...], op: str) -> Column:
    """tags: a row's tag uuids; all_tags() adds those of its elements."""
    want = F.array(*map(F.lit, wanted))
    return F.size(F.array_except(want, tags)) == 0 if op == "AND" else F.arrays_overlap(tags, want)


def all_tags(tags: Column, element_uuid: Column, sub_uuid: Column) -> Column:
    """The set of a row's tags and the uuids of its element and sub-element."""
    none = F.expr("cast(array() as array<string>)")
    return F.filter(F.array_union(F.coalesce(tags, none), F.array(element_uuid, sub_uuid)), lambda t: F.coalesce(t, F.lit("")) != "")


def detail(name: str, f: DetailFilter, types: dict[str, str]) -> Column:
    kind = types.get(name)
    if kind is None:
        raise ValueError(f"the detail {name} is not indexed")
    c = F.col(f"detail_{name}")
    if kind == "INTEGER":
        return numeric_detail(c, f.values, f.op)
    one = {"STRING": text.wildcard, "PATH": text.path, "IP_ADDRESS": _ip}[kind]
    held = F.coalesce(c, F.array(F.lit(MISSING_TEXT)))
    conds = [F.exists(held, _holds(one, x)) for x in f.values]
    return any_of(conds) if f.op == "OR" else all_of(conds)


def _holds(one, value: str):
    return lambda v: F.coalesce(one(v, value), F.lit(False))


def _ip(c: Column, value: str) -> Column:
    try:
        return ip.in_range(c, value)
    except ValueError:
        return ip.substring(c, value)


def clauses(f: EventFilter) -> int:
    """The values of a filter and of all filters in it."""
    ranges = sum(
        len(getattr(f, n)) for n in (
            "severity", "status", "count", "first_seen", "last_seen", "status_change", "update_time", "event_class"
        )
    )
    lists = sum(len(v) for pairs in (f.wildcards, f.identifiers, f.texts, f.tags) for _, v in pairs) + sum(len(d.values) for d in f.details)
    return ranges + lists + sum(clauses(s) for s in f.subfilters) + (clauses(f.not_filter) if f.not_filter else 0)


def condition(f: EventFilter, types: dict[str, str] | None = None) -> Column:
    """The filter as a Column that is never null."""
    out: list[Column] = []
    if f.severity:
        out.append(F.col("severity").isin(*f.severity))
    if f.status:
        out.append(F.col("status").isin(*f.status))
    for name in ("count", "first_seen", "last_seen", "status_change", "update_time"):
        if ranges := getattr(f, name):
            c = F.col("event_count" if name == "count" else name)
            out.append(any_of([_range(c, r) for r in merge_ranges(list(ranges))]))
    for fields, make in ((f.wildcards, text.wildcard), (f.identifiers, text.identifier), (f.texts, text.full_text)):
        for col, values in fields:
            out.append(any_of([make(F.col(col), v) for v in values]))
    if f.event_class:
        out.append(any_of([text.path(F.col("event_class"), v) for v in f.event_class]))
    for op, wanted in f.tags:
        out.append(has_tags(F.col("tags"), wanted, op))
    for d in f.details:
        out.append(detail(d.name, d, types or {}))
    out.extend(condition(s, types) for s in f.subfilters)
    if clauses(f) > MAX_CLAUSES:
        raise ValueError(f"a filter has more than {MAX_CLAUSES} clauses")
    cond = F.lit(True) if not out else (any_of(out) if f.op == "OR" else all_of(out))
    if f.not_filter is not None:
        cond = cond & ~condition(f.not_filter, types)
    return F.coalesce(cond, F.lit(False))
