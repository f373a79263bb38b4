"""Details and tags: ordered lists of named values, merged with built-in functions on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETAILS = "array<struct<name:string,values:array<string>,merge:string>>"


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def merge_duplicates(details: Column) -> Column:
    """Details of one name become one, at the first one's place, with all their values; one pass over the list."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("names"), _empty(DETAILS).alias("out"))

    def step(acc: Column, d: Column) -> Column:
        at = F.array_position(acc["names"], d["name"])
        joined = F.transform(
            acc["out"], lambda o,
            i: F.when(
                i + 1 == at,
                F.struct(o["name"].alias("name"), F.concat(o["values"], d["values"]).alias("values"), o["merge"].alias("merge"))
            ).otherwise(o)
        )
        one = F.struct(d["name"].alias("name"), d["values"].alias("values"), d["merge"].alias("merge"))
        return F.struct(
            F.when(at > 0, acc["names"]).otherwise(F.concat(acc["names"], F.array(d["name"]))).alias("names"),
            F.when(at > 0, joined).otherwise(F.concat(acc["out"], F.array(one))).alias("out")
        )

    return F.aggregate(details, start, step, lambda acc: acc["out"])


def fold(marked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, details) of ordered arrivals (seq, late, details): each detail as its arrivals leave it, in the order of their first ones.

    An arrival that is on time merges its details onto those that are there; under a late one those that are there merge onto its own.
    An arrival that replaces a detail ends what came before it, so only later ones are gathered for each (key, name).
    """
    kind = "struct<has:boolean,values:array<string>,merge:string>"
    each = marked.where("details is not null").select(
        *keys, "seq", "late", F.explode(merge_duplicates(F.col("details").cast(DETAILS))).alias("d")
    ).select(
        *keys, "seq", "late", F.col("d.name").alias("name"), "d.values", F.coalesce("d.merge", F.lit("REPLACE")).alias("merge")
    )
    ends = each.groupBy(*keys, "name").agg(
        F.max(F.when(~F.col("late") & (F.col("merge") == "REPLACE"), F.col("seq"))).alias("from"), F.min("seq").alias("place")
    )
    rest = each.join(ends, [*keys, "name"]).where("from is null or seq >= from")
    lists = rest.groupBy(*keys, "name").agg(
        F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("seq", "late", "merge", "values"))).alias("e")
    )
    less = lambda a, b: F.concat(a, F.array_except(F.array_distinct(b), a))
    made = lambda has, values, merge: F.struct(has.alias("has"), values.alias("values"), merge.alias("merge")).cast(kind)
    yes = F.lit(True)

    def step(acc: Column, e: Column) -> Column:
        fresh = made(yes, e["values"], e["merge"])
        on_time = (
            F.when(e["merge"] == "REPLACE", F.when(F.size(e["values"]) > 0, fresh).otherwise(made(F.lit(False), e["values"], e["merge"])))
            .when(~acc["has"], fresh)
            .when(e["merge"] == "APPEND", made(yes, F.concat(acc["values"], e["values"]), acc["merge"]))
            .otherwise(made(yes, less(acc["values"], e["values"]), acc["merge"]))
        )
        late = (
            F.when(~acc["has"], fresh).when(acc["merge"] == "REPLACE", acc)
            .when(acc["merge"] == "APPEND", made(yes, F.concat(e["values"], acc["values"]), e["merge"]))
            .otherwise(made(yes, less(e["values"], acc["values"]), e["merge"]))
        )
        return F.when(e["late"], late).otherwise(on_time)

    start = made(F.lit(False), F.expr("cast(array() as array<string>)"), F.lit("REPLACE"))
    left = lists.withColumn("x", F.aggregate("e", start, step)).where("x.has")
    one = F.struct("place", "name", "x.values", "x.merge")
    return left.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all")).select(
        *keys,
        F.transform(
            "all", lambda d: F.struct(d["name"].alias("name"), d["values"].alias("values"), d["merge"].alias("merge"))
        ).cast(DETAILS).alias("details")
    )


def merge(old: Column, new: Column) -> Column:
    """New details onto old ones: REPLACE (no values: delete), APPEND, UNIQUE (new values that are not there yet)."""
    old, new = F.coalesce(old, _empty(DETAILS)), F.coalesce(new, _empty(DETAILS))

    def values(o: Column, n: Column) -> Column:
        return F.when(n["merge"] == "APPEND", F.concat(o["values"], n["values"])).when(
            n["merge"] == "UNIQUE", F.concat(o["values"], F.array_except(F.array_distinct(n["values"]), o["values"]))
        ).otherwise(n["values"])

    def upd(o: Column) -> Column:
        n = F.filter(new, lambda d: d["name"] == o["name"])
        return F.when(
            F.size(n) > 0, F.struct(o["name"].alias("name"), values(o, n[0]).alias("values"), n[0]["merge"].alias("merge"))
        ).otherwise(F.struct(o["name"].alias("name"), o["values"].alias("values"), o["merge"].alias("merge")))

    fresh = F.filter(new, lambda d: ~F.exists(old, lambda o: o["name"] == d["name"]))
    return F.filter(F.concat(F.transform(old, upd), fresh), lambda d: (F.size(d["values"]) > 0))


def fit(details: Column, limit: int, important: tuple[str, ...]) -> Column:
    """Details too large as JSON keep only those whose names have an important prefix."""
    keep = lambda d: F.exists(F.array(*map(F.lit, important)), lambda p: d["name"].startswith(p))
    return F.when(F.length(F.to_json(details)) * 2 < limit, details).otherwise(F.filter(details, keep))


def merge_within(old: Column, new: Column, limit: int, important: tuple[str, ...]) -> Column:
    """Merged details, or only the new ones where that is too large, or of those only the important ones."""
    both = merge(old, new)
    fits = lambda d: F.length(F.to_json(d)) * 2 < limit
    return F.when(fits(both), both).otherwise(fit(new, limit, important))


def normalise_tags(tags: Column) -> Column:
    """array<struct<type,uuids>>: one entry for each type, sorted; a uuid stays with its first type."""
    flat = F.flatten(F.transform(tags, lambda t: F.transform(t["uuids"], lambda u: F.struct(t["type"].alias("type"), u.alias("uuid")))))
    first = F.filter(flat, lambda x, i: ~F.exists(F.slice(flat, 1, i), lambda y: y["uuid"] == x["uuid"]))
    types = F.array_sort(F.array_distinct(F.transform(first, lambda x: x["type"])))
    return F.transform(
        types,
        lambda t: F.struct(t.alias("type"), F.transform(F.filter(first, lambda x: x["type"] == t), lambda x: x["uuid"]).alias("uuids"))
    )


def first_value(details: Column, name: str) -> Column:
    return F.get(F.filter(details, lambda d: d["name"] == name), 0)["values"][0]
