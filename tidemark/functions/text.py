"""Search-language text predicates as Column expressions: globs, tokens, phrases, paths, identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """An anchored regular expression of a pattern with * and ?."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def unquote(value: str) -> tuple[str, bool]:
    """The value without its quotes, and whether it had an opening one (an unterminated quote counts)."""
    if value.startswith('"'):
        return (value[1:-1] if len(value) > 1 and value.endswith('"') else value[1:]), True
    return value, False


def matches(col: Column, glob: str) -> Column:
    """Whole-value match; equality, prefix and suffix patterns stay plain so that scans can use them."""
    if "*" not in glob and "?" not in glob:
        return col == glob
    if glob.endswith("*") and not re.search(r"[*?]", glob[:-1]):
        return col.startswith(glob[:-1])
    return col.rlike("(?s)" + glob_regex(glob))


def wildcard(col: Column, value: str) -> Column:
    """Case-sensitive, whole value. A value that is only * or empty equals the empty string."""
    value, _ = unquote(value)
    return F.coalesce(col, F.lit("")) == "" if value.strip("*") == "" else matches(col, value)


def tokens(col: Column, pattern: str = r"\s+") -> Column:
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), pattern), lambda t: t != "")


def _part(glob: str, inner: str) -> str:
    """A pattern as a regular expression inside one token; `inner` matches a token's characters."""
    return "".join(f"{inner}*" if c == "*" else inner if c == "?" else re.escape(c) for c in glob)


def phrase(joined: Column, parts: list[str], sep: str, inner: str) -> Column:
    """Whether consecutive tokens of a text match the patterns: one regular expression over the text, which is never split.

    `sep` and `inner` are character classes of what parts tokens and of what is in them.
    """
    if not parts:
        return F.lit(False)
    run = f"{sep}+".join(_part(p, inner) for p in parts)
    return joined.rlike(f"(?s)(?<!{inner}){run}(?!{inner})")


def full_text(col: Column, value: str) -> Column:
    """All tokens, in any order; text in quotes is a run of consecutive tokens."""
    low, cond = F.lower(F.coalesce(col, F.lit(""))), F.lit(True)
    for quoted, bare in re.findall(r'"([^"]*)"?|([^\s"]+)', value.lower()):
        cond = cond & phrase(low, quoted.split() if quoted else [bare], r"\s", r"\S")
    return cond


def identifier(col: Column, value: str) -> Column:
    """Case-insensitive. Quoted: whole value. Short values are prefixes of a trigram, longer ones substrings of a token."""
    low = F.lower(F.coalesce(col, F.lit("")))
    value, quoted = unquote(value.lower())
    if quoted or not value:
        return matches(low, value)
    value = value.rstrip("*")
    if len(value) < 3:
        return F.exists(tokens(col), lambda t: F.substring(t, 1, F.greatest(F.length(t) - (3 - len(value)), F.lit(0))).contains(value))
    return F.exists(tokens(col), lambda t: t.contains(value))


def path(col: Column, value: str) -> Column:
    """Hierarchical paths: /a/ and /a* are prefixes, /a/b is exact, a/b is a run of segments."""
    value = value.lower().lstrip("*") if not value.startswith("/") else value.lower()
    stored = F.concat(F.lower(F.coalesce(col, F.lit(""))), F.lit("/"))
    if value.startswith("/"):
        if value.endswith(("/", "*")):
            return stored.startswith(
                value.rstrip("*").rstrip("/") + "/"
            ) if value.rstrip("*").endswith("/") else stored.startswith(value.rstrip("*"))
        return stored == value + "/"
    return phrase(stored, [p for p in value.split("/") if p], "/", "[^/]")


def clear_fingerprints(element: Column, sub: Column, classes: Column, key: Column, sub_uuid: Column) -> Column:
    """The hashes of all that a clear ends: for each of its classes the one by identifiers and, with a sub-element's uuid, the one by that."""
    e = lambda c: F.coalesce(c, F.lit(""))
    old = F.transform(classes, lambda c: F.sha1(F.concat_ws("|", e(element), e(sub), c, e(key))))
    new = F.when(
        e(sub_uuid) != "", F.transform(classes, lambda c: F.sha1(F.concat_ws("|", sub_uuid, c, e(key))))
    ).otherwise(F.expr("cast(array() as array<string>)"))
    return F.when(e(element) != "", F.concat(old, new)).otherwise(F.expr("cast(array() as array<string>)"))


def uuid_text(binary: Column) -> Column:
    """16 bytes as a uuid of 36 characters."""
    h = F.lower(F.hex(binary))
    return F.when(binary.isNotNull(), F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def uuid_bytes(text: Column) -> Column:
    return F.unhex(F.regexp_replace(text, "-", ""))


def sha1_text(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def millis_text(ms: Column) -> Column:
    """Milliseconds since the epoch as YYYY-MM-DD HH:MM:SS.mmm, in UTC whatever the session's zone."""
    utc = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd HH:mm:ss.SSS")


def title_or_id(title: Column, identifier_: Column) -> Column:
    return F.coalesce(title, identifier_)


def truncate_utf8(col: Column, n: int) -> Column:
    """The longest prefix of whole characters within n bytes."""
    few = F.substring(col, 1, n)
    sizes = F.aggregate(
        F.split(few, ""),
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")),
        lambda a,
        c: F.when(
            a["bytes"] + F.octet_length(c) <= n, F.struct((a["bytes"] + F.octet_length(c)).alias("bytes"), (a["chars"] + 1).alias("chars"))
        ).otherwise(F.struct(F.lit(n).alias("bytes"), a["chars"].alias("chars"))),
    )
    return F.when(F.octet_length(col) <= n, col).otherwise(F.substring(col, F.lit(1), sizes["chars"]))


def organizer_ancestors(paths: Column) -> Column:
    """/a/b/c becomes /a, /a/b and /a/b/c; distinct and sorted over a list of paths."""
    def up(p: Column) -> Column:
        parts = F.filter(F.split(p, "/"), lambda s: s != "")
        return F.when(
            F.size(parts) > 0,
            F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
        ).otherwise(F.expr("cast(array() as array<string>)"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(paths, up))))


def routing_key(event_class: Column, prefix: str = "tidemark.event.") -> Column:
    return F.concat(F.lit(prefix), F.translate(F.lower(F.regexp_replace(event_class, "^/", "")), "/ ", "._"))


def clear_fingerprint(element: Column, sub: Column, event_class: Column, key: Column, sub_uuid: Column | None = None) -> Column:
    """The hash that ties a clear to the events that it clears; null without an element or class."""
    def e(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    old = F.concat_ws("|", e(element), e(sub), e(event_class), e(key))
    text = old if sub_uuid is None else F.when(e(sub_uuid) != "", F.concat_ws("|", sub_uuid, e(event_class), e(key))).otherwise(old)
    return F.when((e(element) != "") & (e(event_class) != ""), F.sha1(text))
