"""Stored tables, sinks, hooks and the engine's functions."""

import pytest
from pyspark.sql import functions as F

from tidemark import api, model
from tidemark.operators import details, lookup, notes
from tidemark.operators.filters import EventFilter
from tidemark.operators.plugins import Hooks
from tidemark.plans.query import EventQuery, Sort
from tidemark.sinks import tables as sinks
from tidemark.streaming import engine

HOUR = 3_600_000


def test_partitions_are_made_pruned_and_compacted(spark, tmp_path):
    t = sinks.PartitionedTable(spark, str(tmp_path / "times"), "processed", HOUR, "hour")
    rows = spark.createDataFrame([(f"u{i}", i * HOUR // 2) for i in range(12)], "uuid string, processed long")
    assert t.partitions() == []
    t.append(rows.where("processed < 3 * 3600000"))
    t.append(rows.where("processed >= 3 * 3600000"))
    t.append(rows.limit(1))
    assert t.partitions() == [0, 1, 2, 3, 4, 5] and t.read().count() == 13
    t.compact(0)
    assert t.read().where("hour = 0").count() == 3 and len(list((tmp_path / "times" / "hour=0").glob("*.parquet"))) == 1
    assert t.prune(6 * HOUR, keep=2) == [0, 1, 2, 3] and t.partitions() == [4, 5] and t.read().count() == 4
    assert t.prune(6 * HOUR, keep=2) == []


def test_sinks_and_fan_out(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'say "x", y', "k.one"), ("b", None, "k.two")], "uuid string, text string, key string")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    seen = []
    both = sinks.fan_out([lambda df, n: sinks.write_json(df, str(tmp_path / "json"), "key"), lambda df, n: seen.append((n, df.count()))])
    both(rows, 3)
    assert seen == [(3, 2)] and {p.name for p in (tmp_path / "json").glob("key=*")} == {"key=k.one", "key=k.two"}


def test_hooks_run_in_order(spark):
    said = []
    h = Hooks(
        post_index=[
            (lambda b: said.append("start1"), None, lambda b: said.append("run1"), lambda b: said.append("end1")),
            (None, lambda b: said.append("prepare2"), lambda b: said.append("run2"))
        ]
    )
    h.post_create.append(lambda o, s: said.append("created"))
    h.created(None, None)
    h.indexed(None)
    assert said == ["created", "start1", "prepare2", "run1", "run2", "end1"]


def summaries(spark):
    rows = [
        (
            f"{i:x}0", f"f{i}", f"h{i}", "/A/B" if i % 2 else "/C", i % 6, i % 3, f"dev{i % 4}", None, i, 10 * i, 20 * i, 20 * i, 0, None,
            None, None, ["t", f"t{i % 2}"]
        ) for i in range(12)
    ]
    kinds = "uuid string, fingerprint string, fingerprint_hash string, event_class string, severity int, status int, element_identifier string, element_uuid string, event_count long, first_seen long, last_seen long, status_change long, update_time long, user_name string"
    return spark.createDataFrame(rows, kinds + f", notes {notes.NOTES}, details {details.DETAILS}, tags array<string>")


def test_engine(spark):
    s = summaries(spark)
    said = []
    e = api.Engine(
        s.where("event_count < 10"), s.where("event_count >= 10"), clock=lambda: 1000,
        hooks=Hooks(update=[lambda kind, uuids, change: said.append((kind, uuids.count()))])
    )
    rows, hits = e.list(EventQuery(EventFilter(severity=(1, 2)), sort=(Sort("event_count", True),), limit=2))
    assert [r["event_count"] for r in rows.collect()] == [8, 7] and hits.first().asDict() == {"total": 4, "next_offset": 2}
    assert e.get("a0").first()["event_count"] == 10 and e.get("30").first()["event_count"] == 3 and e.get("zz").count() == 0
    e.update(s.where("uuid in ('00', '30')").select("uuid"), model.ACKNOWLEDGED, "me")
    assert {r["uuid"] for r in e.summaries.where("user_name = 'me'").collect()} == {"00", "30"}
    at, more = e.update_search(s.where("event_count in (0, 3, 6)").select("uuid"), model.CLOSED, limit=2)
    assert (at, more) == (2, True) and e.summaries.where("status = 3").count() == 2
    e.add_note("a0", "seen", "u", "U")
    e.add_note("10", "here", "u", "U")
    assert [
        n["message"] for n in e.archive.where("uuid = 'a0'").first()["notes"]
    ] == ["seen"] and e.summaries.where("size(notes) = 1").count() == 1
    e.update_details(
        "10", F.array(F.struct(F.lit("k").alias("name"), F.array(F.lit("1")).alias("values"), F.lit("REPLACE").alias("merge")))
    )
    assert e.summaries.where("uuid = '10'").first()["details"][0]["values"] == ["1"]
    assert said == [("status", 2), ("status", 2), ("note", 1), ("note", 1), ("details", 1)]
    roll = e.tag_severities(EventFilter(severity=(1,)), ["t1", "none"])
    assert {
        (r["tag"], r["total"]) for r in roll.collect()
    } == {("t1", 8), ("none", 0)} and e.tag_severities(EventFilter(severity=(1,)), ["t1", "none"]) is roll
    name = e.create_saved_search(EventQuery(EventFilter(event_class=("/A/",)), sort=(Sort("event_count"),)))
    assert [
        r["event_count"] for r in e.search_page(name, 1, 2).collect()
    ] == [3, 5] and e.delete_saved_search(name) and not e.delete_saved_search(name)
    e.age(900, model.CRITICAL)
    assert e.summaries.where("status = 6").count() == e.summaries.where("severity < 5 and last_seen < 100 and status = 6").count() > 0
    n = e.summaries.where("status in (3, 6) and last_seen < 500").count()
    e.archive_old(500, limit=2)
    assert n > 2 and e.archive.count() == 4 and e.summaries.count() == 8
    e.beat(spark.createDataFrame([("m", "a", 5, 1), ("m", "b", 6, 1)], "monitor string, daemon string, last_time long, timeout_s int"))
    e.beat(spark.createDataFrame([("m", "a", 9, 1)], "monitor string, daemon string, last_time long, timeout_s int"))
    assert sorted((r["daemon"], r["last_time"]) for r in e.beats.collect()) == [("a", 9), ("b", 6)]
    e.delete_beats("m", "b")
    assert [r["daemon"] for r in e.beats.collect()] == ["a"]


def test_rollups_are_kept_for_a_while():
    clock, made = [0.0], []
    c = api.RollupCache(5, 2, lambda: clock[0])
    get = lambda k: c.get(k, lambda: made.append(k) or len(made))
    assert [get("a"), get("a"), get("b"), get("c"), get("a")] == [1, 1, 2, 3, 4]
    clock[0] = 6
    assert get("c") == 5


def test_a_rebuild_goes_on_where_it_ended(spark):
    written, done = [], {"0", "1"}
    api.rebuild(summaries(spark), lambda df, d: written.extend(r["uuid"] for r in df.collect()), done, done.add)
    assert sorted(written) == sorted(f"{i:x}0" for i in range(2, 12)) and len(done) == 16


def test_streams_of_beats_and_changes(spark, tmp_path):
    beats = spark.createDataFrame(
        [("m", "a", 5, 1), ("m", "a", 9, 2), ("m", "b", 1, 3)], "monitor string, daemon string, last_time long, timeout_s int"
    )
    beats.coalesce(1).write.parquet(str(tmp_path / "in"))
    t = engine.LatestTable(spark, str(tmp_path / "beats"), ("monitor", "daemon"), "last_time")
    read = lambda p, schema: spark.readStream.schema(schema).parquet(str(tmp_path / p))
    t.run(read("in", beats.schema), str(tmp_path / "c1")).awaitTermination()
    t.fold(spark.createDataFrame([("m", "b", 7, 4), ("m", "a", 8, 5)], beats.schema), 1)
    assert sorted(map(tuple, t.read(1).collect())) == [("m", "a", 9, 2), ("m", "b", 7, 4)]
    s = summaries(spark)
    changes = spark.createDataFrame([("10",), ("10",), ("gone",)], "uuid string")
    changes.coalesce(1).write.parquet(str(tmp_path / "changes"))
    seen, said = [], []
    hooks = Hooks(post_index=[(lambda b: said.append(b.count()),)])
    engine.index_changes(
        read("changes", changes.schema), lambda u: lookup.by_uuids(s, u), lambda rows,
        gone: seen.append(([r["uuid"] for r in rows.collect()], [r["uuid"] for r in gone.collect()])), str(tmp_path / "c2"), hooks
    ).awaitTermination()
    assert seen == [(["10"], ["gone"])] and said == [1]


def test_a_missing_version_is_an_error(spark, tmp_path):
    t = engine.SummaryTable(spark, str(tmp_path / "t"))
    with pytest.raises(RuntimeError, match="missing"):
        t.fold(spark.createDataFrame([("a",)], "uuid string"), 4)


def test_a_batch_writes_only_its_parts(spark, tmp_path):
    from tidemark.operators import state

    occ = "uuid string, arrival_seq long, count int, created long, event_class string, severity int, status int, element_identifier string, element_uuid string, fingerprint string"
    row = lambda i, f: (f"u{i}", i, 1, 10 * i, "/A", 3, 0, "h", "e", f)
    batches = [[row(i, f"f{i % 40}") for i in range(80)], [row(100, "f7"), row(101, "f7")], [row(102, "f8")], [row(103, "f7")]]
    t = engine.SummaryTable(spark, str(tmp_path / "t"))
    for n, rows in enumerate(batches):
        t.fold(spark.createDataFrame(rows, occ), n)
        if n == 1:
            t.fold(spark.createDataFrame(rows, occ), n)  # run again after a failure
    assert len(list((tmp_path / "t" / "v=000000000002").glob("part=*"))) == 1
    assert {p.name for p in (tmp_path / "t").iterdir()} == {f"manifest={n:012d}" for n in (2, 3)} | {f"v={n:012d}" for n in (0, 1, 2, 3)}
    cols = ["uuid", "fingerprint", "event_count", "last_seen", "status_change"]
    want = state.dedup(spark.createDataFrame([r for b in batches for r in b], occ))
    assert sorted(map(tuple, t.read(3).select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_export_cuts_fields_and_leaves_out_what_is_too_large_or_not_valid(spark):
    from tidemark.plans import views

    rows = [
        ("a", "f", "e", 4, 0, 9, "x" * 30, "m"), ("b", "f", "e", 4, 1, 9, "é" * 6, "m"), ("c", "f", None, 4, 0, 9, "s", "m"), ("d", "", "e", 4, 0, 9, "s", "m"),
        ("e", "f", "e", 4, 0, 0, "s", "m"), ("f", "f", "e", 1, 0, 9, "s", "m"), ("g", "f", "e", 5, model.DROPPED, 9, "s", "m" * 5000), ("h", "f", "e", 0, 0, 9, "s", "m"),
    ]
    df = spark.createDataFrame(rows, "uuid string, fingerprint string, element_uuid string, severity int, status int, last_seen long, summary string, message string")
    got = {r["uuid"]: r for r in views.export_record(df.where("severity <> 0"), "t", "s", model.INFO, field_bytes=10, max_bytes=100_000).collect()}
    assert set(got) == {"a", "b", "g"} and got["a"]["summary"] == "x" * 10 and got["b"]["summary"] == "é" * 6
    assert got["g"]["status"] == "CLOSED" and got["g"]["acknowledged"] is None and got["g"]["body"] == "m" * 10 and got["b"]["acknowledged"] is True
    assert got["a"]["metadata"]["context_uuid"] == ["e"] and "monitor" not in got["a"]["metadata"]
    clear = views.export_record(df.where("severity = 0"), "t", "s", model.CLEAR).first()
    assert (clear["status"], clear["severity"]) == ("CLOSED", "DEFAULT")
    assert views.export_record(df, "t", "s", model.INFO, field_bytes=10_000, max_bytes=2000).where("uuid = 'g'").count() == 0
