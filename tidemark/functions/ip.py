"""IP addresses: literals are parsed on the driver, columns with built-in functions."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import matches, phrase


def canonical(value: str) -> str:
    """Zero-padded, so that the order of strings is the order of addresses of one family."""
    a = ipaddress.ip_address(value)
    return ".".join(f"{int(p):03d}" for p in str(a).split(".")) if a.version == 4 else a.exploded


def parse_range(value: str) -> tuple[str, str, str]:
    """(family, first, last) of a-b, a-lastpart, a/prefix, a/netmask or one address."""
    if "/" in value:
        net = ipaddress.ip_network(value, strict=False)
        return str(net.version), canonical(str(net[0])), canonical(str(net[-1]))
    first, _, last = value.partition("-")
    if not last:
        last = first
    a = ipaddress.ip_address(first)
    if a.version == 4 and "." not in last:
        last = first.rsplit(".", 1)[0] + "." + last
    elif a.version == 6 and ":" not in last:
        last = a.exploded.rsplit(":", 1)[0] + ":" + last
    b = ipaddress.ip_address(last)
    if a.version != b.version or b < a:
        raise ValueError(f"no range of addresses: {value}")
    return str(a.version), canonical(str(a)), canonical(str(b))


def netmask_to_prefix(mask: str) -> int:
    bits = int(ipaddress.ip_address(mask))
    size = 32 if "." in mask else 128
    n = bin(bits).count("1")
    if bits != ((1 << n) - 1) << (size - n):
        raise ValueError(f"not a netmask: {mask}")
    return n


def prefix_to_netmask(bits: int, v6: bool = False) -> str:
    size = 128 if v6 else 32
    return str((ipaddress.IPv6Address if v6 else ipaddress.IPv4Address)(((1 << bits) - 1) << (size - bits)))


def ip_type(col: Column) -> Column:
    return F.when(col.contains(":"), "6").when(col.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "4")


def _v6_parts(col: Column) -> Column:
    """The eight groups, with :: filled."""
    low = F.lower(col)
    head = F.filter(F.split(F.substring_index(low, "::", 1), ":"), lambda s: s != "")
    tail = F.when(
        low.contains("::"), F.filter(F.split(F.substring_index(low, "::", -1), ":"), lambda s: s != "")
    ).otherwise(F.expr("cast(array() as array<string>)"))
    gap = F.greatest(8 - F.size(head) - F.size(tail), F.lit(0))
    return F.concat(head, F.array_repeat(F.lit("0"), gap), tail)


def canonical_column(col: Column) -> Column:
    v4 = F.array_join(F.transform(F.split(col, r"\."), lambda p: F.lpad(p, 3, "0")), ".")
    v6 = F.array_join(F.transform(_v6_parts(col), lambda p: F.lpad(p, 4, "0")), ":")
    return F.when(ip_type(col) == "4", v4).when(ip_type(col) == "6", v6)


def tokens(col: Column) -> Column:
    """Octets or groups without leading zeros."""
    parts = F.when(ip_type(col) == "4", F.split(col, r"\.")).otherwise(_v6_parts(col))
    return F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=.)", ""))


def in_range(col: Column, value: str) -> Column:
    family, first, last = parse_range(value)
    c = canonical_column(col)
    return (ip_type(col) == family) & c.between(first, last)


def exact(col: Column, value: str) -> Column:
    return canonical_column(col) == canonical(value)


def substring(col: Column, value: str) -> Column:
    """Consecutive octets (with .) or groups (with :) that may have wildcards; else one of either."""
    value = value.lower()
    family, sep = ("4", ".") if "." in value else ("6", ":") if ":" in value else (None, None)
    parts = [re.sub(r"^0+(?=[0-9a-f])", "", p) for p in (value.split(sep) if sep else [value]) if p]
    if not parts:
        return F.lit(False)
    if sep is None:
        return F.exists(tokens(col), lambda t: matches(t, parts[0]))
    return (ip_type(col) == family) & phrase(F.array_join(tokens(col), sep), parts, re.escape(sep), f"[^{sep}]")
