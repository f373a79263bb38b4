"""Fixtures of the search language, the state rules and the reactions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import ip, text
from tidemark.operators import details, reactions, state
from tidemark.operators.filters import DetailFilter, EventFilter, condition, has_tags, merge_ranges, numeric_detail, parse_count, parse_number
from tidemark.plans.query import EventQuery, SavedSearches, Sort, page, total


def hits(df, cond):
    return {r[0] for r in df.where(cond).select("id").collect()}


def check(df, make, cases):
    """All cases in one pass."""
    cols = [F.coalesce(make(F.col("v"), q), F.lit(False)).alias(f"c{i}") for i, (q, _) in enumerate(cases)]
    rows = df.select("id", *cols).collect()
    for i, (q, want) in enumerate(cases):
        assert {r["id"] for r in rows if r[f"c{i}"]} == set(want), q


def test_paths(spark):
    """A trailing slash or star is a prefix, a leading slash alone is exact, anything else is a run of whole segments."""
    df = spark.createDataFrame(
        [(1, "/Net/Wan"), (2, "/Net/Lan/Port"), (3, "/Disk"), (4, "/Site/Net/Wan"), (5, None), (6, "/Network")], "id int, v string"
    )
    check(df, text.path, [
        ("/Disk", [3]), ("/net", []), ("/net/", [1, 2]), ("/net*", [1, 2, 6]), ("/NET/*", [1, 2]), ("/net/lan/PORT", [2]), ("wan", [1, 4]),
        ("w?n", [1, 4]), ("net/wan", [1, 4]),
        ("n*/l*", [2]), ("wan/net", []), ("net/wanderer", []), ("wa", []), ("*disk", [3]), ("site/*/wan", [4]), ("lan//port", [2]),
    ])


def test_full_text(spark):
    """Tokens in any order, quoted ones as a run; wildcards stay inside a token; signs of regular expressions mean themselves."""
    df = spark.createDataFrame(
        [(1, "Fan  speed\tlow on rack 7"), (2, "rack 7 fan replaced, speed (ok)"), (3, None), (4, "a.c unit [x] fails")], "id int, v string"
    )
    check(df, text.full_text, [
        ("speed FAN", [1, 2]), ('"fan speed"', [1]), ('"speed fan"', []), ('"rack 7', [1, 2]), ('"7 fan"', [2]), ('"f?n sp*d"', [1]),
        ('"rack 7" low', [1]), ("sp", []), ("sp*", [1, 2]), ("*ed", [1, 2]),
        ("(ok)", [2]), ("a.c", [4]), ("a?c", [4]), ("abc", []), ("[x]", [4]), ("replaced", []), ("replaced?", [2]), ('"fan * low"', [1]),
        ('"on rack" nothing', []),
    ])


def test_identifiers_and_wildcards(spark):
    df = spark.createDataFrame([(1, "Core-Switch.north"), (2, "edge-router.NORTH"), (3, "Zx81")], "id int, v string")
    check(
        df, text.identifier,
        [
            ("switch", [1]), ("North", [1, 2]), ("rout*", [2]), ("-", [1, 2]), ('"CORE-switch.North"', [1]), ('"edge*"', [2]),
            ('"edge"', []), ("ZX", [3]), ("81", []), ("x81", [3])
        ]
    )
    check(df, text.wildcard, [("Zx*", [3]), ("zx*", []), ("*", []), ("*north", [1]), ("Zx?1", [3]), ("Zx81", [3]), ("?x81", [3])])


def test_ip(spark):
    assert ip.canonical("10.1.22.3") == "010.001.022.003" and ip.canonical("2001:db8::7") == "2001:0db8:0000:0000:0000:0000:0000:0007"
    assert ip.parse_range("172.16.5.77/27")[1:] == (
        ip.canonical("172.16.5.64"), ip.canonical("172.16.5.95")
    ) and ip.parse_range("2001:db8::5-a0")[2] == ip.canonical("2001:db8::a0")
    for bad in ("10.0.0.9-10.0.0.8", "2001:db8::b-2001:db8::a", "10.0.0.1-2001:db8::1"):
        with pytest.raises(ValueError):
            ip.parse_range(bad)
    assert ip.netmask_to_prefix("255.255.248.0") == 21 and ip.prefix_to_netmask(21) == "255.255.248.0"
    with pytest.raises(ValueError):
        ip.netmask_to_prefix("255.0.255.0")
    # 10a0::1 sorts between 10.0.0.0 and 11.0.0.0 as text, but is of another family
    df = spark.createDataFrame([(1, "10.9.8.1"), (2, "10.9.8.20"), (3, "10.9.8.130"), (4, "10.9.9.1"), (5, "10a0::1")], "id int, v string")
    check(
        df, ip.in_range,
        [
            ("10.9.8.1-10.9.8.20", [1, 2]), ("10.9.8.20-130", [2, 3]), ("10.9.8.0/25", [1, 2]), ("10.9.8.0/255.255.254.0", [1, 2, 3, 4]),
            ("10.0.0.0-11.0.0.0", [1, 2, 3, 4]), ("10.9.9.1", [4])
        ]
    )
    check(
        df, ip.substring,
        [
            ("9.8", [1, 2, 3]), ("8.1*", [1, 3]), ("8.?", [1]), ("008.020", [2]), ("130", [3]), ("9.1", [4]), ("9.1.", [4]), ("..", []),
            ("words", [])
        ]
    )
    df = spark.createDataFrame([(1, "2001:db8::15"), (2, "2001:db8::1:15"), (3, "2001:db8:15::")], "id int, v string")
    check(
        df, ip.in_range, [("2001:db8::/64", [1, 2]), ("2001:db8::10-2001:db8::1f", [1]), ("2001:db8::10-1f", [1]), ("2001:db8:15::", [3])]
    )
    check(df, ip.substring, [("db8:0", [1, 2]), ("0:15", [1]), ("1:0015", [2]), ("db8:1?", [3]), ("15", [1, 2, 3])])
    df = spark.createDataFrame([("p", "2001::"), ("q", "9.0.0.1"), ("r", "10.0.0.1"), ("s", "fe80::2")], "uuid string, addr string")
    assert [r["uuid"] for r in page(df, EventQuery(sort=(Sort("addr", kind="ip"),))).collect()] == ["q", "r", "p", "s"]


def test_numeric_details(spark):
    """A row without the detail counts as the least number."""
    df = spark.createDataFrame([(1, [7]), (2, [70, 90]), (3, [700]), (4, None)], "id int, v array<int>")
    cases = [
        (("70",), {2}), ((":75",), {1, 2, 4}), (("80:",), {2, 3}), (("6", "7", "8"), {1}), (("60:99",), {2}), (("5", "600:", ":6"), {3, 4}),
        (("71:89",), set())
    ]
    for q, want in cases:
        assert hits(df, numeric_detail(F.col("v"), q)) == want, q
    assert hits(df, numeric_detail(F.col("v"), ("70", "90"), "AND")) == {2}
    for bad in ("7.5", "9:8", ":", "many"):
        with pytest.raises(ValueError):
            parse_number(bad)
    assert [parse_count(x) for x in (">4", ">=4", "<=4", "<4", "4", "=4", "4:", "4:6", ":6", "", None)] == [
        (5, None), (4, None), (None, 4), (None, 3), (4, 4), (4, 4), (4, None), (4, 6), (None, 6), None, None
    ]
    for bad in ("-3", "=-3", "=<3", "6:4"):
        with pytest.raises(ValueError):
            parse_count(bad)
    assert merge_ranges([(20, 30), (31, 40), (60, None), (50, 50), (None, 5)]) == [(None, 5), (20, 40), (50, 50), (60, None)]
    with pytest.raises(ValueError):
        condition(EventFilter(details=(DetailFilter("colour", ("1",)),)), {})
    many = EventFilter(subfilters=tuple(EventFilter(severity=(1,) * 300) for _ in range(4)))
    with pytest.raises(ValueError, match="clauses"):
        condition(many)


def test_requests():
    from tidemark.plans.request import event_filter, event_query, parse_time, parse_times

    assert parse_time("1970-01-02T00:00:01Z") == 86_401_000 and parse_time("1970-01-01T00:00:00.250Z") == 250
    assert parse_times("1970-01-01T00:00:01Z") == (1000, None) and parse_times("1970-01-01T00:00:01Z/1970-01-01T00:00:02Z") == (1000, 2000)
    for bad in ("1970-01-01", "1970-01-01T00:00:00+01:00", "1970-13-01T00:00:00Z"):
        with pytest.raises(ValueError):
            parse_time(bad)
    with pytest.raises(ValueError):
        parse_times("1970-01-01T00:00:02Z/1970-01-01T00:00:01Z")
    q = event_query(
        {"severity": ["debug", "SEVERITY_CLEAR"], "ex_status": ["NEW"], "uuid": ["a*"], "offset": ["3"], "sort": ["LAST_SEEN,DESCENDING"]}
    )
    assert q.filter == EventFilter(
        severity=(model.DEBUG, model.CLEAR), wildcards=(("uuid", ("a*",)),)
    ) and q.exclusion == EventFilter(status=(model.NEW,)) and (q.offset, q.limit) == (3, 1000)
    assert q.sort == (Sort("last_seen", True),) and event_query({}).exclusion is None
    for bad in ({"limit": ["-1"]}, {"sort": ["UUID,UP"]}, {"severity": ["LOUD"]}, {"tag_uuids": ["x"], "tag_uuids_op": ["XOR"]}):
        with pytest.raises(ValueError):
            event_query(bad)
    assert event_filter({"count": ["4:6"]}).count == ((4, 6),)


def test_filter_algebra_tags_and_paging(spark):
    df = spark.createDataFrame(
        [("a", model.INFO, model.NEW, ["t1", "t2"]), ("b", model.DEBUG, model.CLOSED, ["t1"]), ("c", model.ERROR, model.NEW, ["t2"])],
        "id string, severity int, status int, tags array<string>"
    )
    both = {"severity": (model.INFO,), "status": (model.CLOSED,)}
    assert hits(df, condition(EventFilter(**both, op="OR"))) == {"a", "b"} and hits(df, condition(EventFilter(**both))) == set()
    assert hits(df, condition(EventFilter(not_filter=EventFilter(severity=(model.ERROR,))))) == {"a", "b"}
    assert hits(df, has_tags(F.col("tags"), ("t1", "t2"), "OR")) == {"a", "b", "c"} and hits(
        df, has_tags(F.col("tags"), ("t1", "t2"), "AND")
    ) == {"a"}
    u = df.withColumnRenamed("id", "uuid")
    assert page(u, EventQuery(limit=0)).count() == 0 and total(u, EventQuery(limit=0)).first().asDict() == {"total": 3, "next_offset": 0}
    with pytest.raises(ValueError):
        page(u, EventQuery(limit=-1))
    clock = [0.0]
    saved = SavedSearches(lambda x: x, 10, lambda: clock[0])
    name = saved.create(u, EventQuery(sort=(Sort("severity", True),)))
    assert [r["uuid"] for r in saved.page(name, 1, 1).collect()] == ["a"]
    clock[0] = 11.0
    with pytest.raises(KeyError):
        saved.page(name, 0, 1)


OCC = "uuid string, arrival_seq long, count int, created long, event_class string, severity int, status int, element_identifier string, element_uuid string, fingerprint string"


def occ(spark, rows):
    return spark.createDataFrame([(f"u{i}", i, c, t, "/A", 4, st, "h", "e", "f") for i, (c, t, st) in enumerate(rows)], OCC)


def test_dedup_rules(spark):
    r = state.dedup(occ(spark, [(3, 500, 0)] * 4)).first()
    assert (r["event_count"], r["uuid"], r["status_change"]) == (12, "u0", 500)
    r = state.dedup(occ(spark, [(1, 900, 1), (1, 300, 0), (1, 600, 2)])).first()
    assert (r["status"], r["first_seen"], r["last_seen"], r["event_count"], r["status_change"]) == (1, 300, 900, 3, 900)
    assert state.dedup(occ(spark, [(1, 10, 1), (1, 20, 0), (1, 30, 2)])).first()["status"] == model.ACKNOWLEDGED
    r = state.dedup(occ(spark, [(1, 10, 0), (1, 5, 1), (1, 20, 2), (1, 25, 2)])).first()
    assert (r["status"], r["status_change"]) == (model.SUPPRESSED, 20)
    raw = spark.createDataFrame(
        [("a", 1, "", 0), ("", 1, "/x", 0), ("b", None, "/x", 0), ("c", 1, "/x", model.DROPPED)],
        "uuid string, created long, event_class string, status int"
    )
    assert [(x["uuid"], x["event_class"]) for x in state.validate(raw).collect()] == [("a", "/Unknown")]
    assert sorted(x["reason"] for x in state.rejected(raw).collect()) == ["dropped", "no time", "no uuid"]


def plain_fold(rows):
    """The rules one occurrence after the other: {hash kind: [count, first, last, status, change]}; rows are (count, created, status)."""
    out = {}
    for n, t, st in rows:
        key = ("closed", t) if st in model.CLOSED_STATUSES else "active"
        if key not in out:
            out[key] = [n, t, t, st, t]
            continue
        x = out[key]
        x[0] += n
        x[1] = min(x[1], t)
        if t >= x[2]:
            x[2] = t
            if not (x[3] == model.ACKNOWLEDGED and st in (model.NEW, model.SUPPRESSED)) and x[3] != st:
                x[3:] = [st, t]
    return sorted(map(tuple, out.values()))


def test_dedup_equals_the_rules_one_by_one(spark):
    """In blocks of any size, in batches folded into stored summaries, and with aged summaries that come back."""
    rng = random.Random(8)
    for case in range(6):
        rows = [(rng.randint(1, 3), rng.randint(0, 60), rng.choice([0, 0, 2, 1, 3] if case % 2 else [0, 2, 2, 1])) for _ in range(40)]
        want = plain_fold(rows)
        df = occ(spark, rows)
        shown = lambda s: sorted(
            tuple(r) for r in s.select("event_count", "first_seen", "last_seen", "status", "status_change").collect()
        )
        assert shown(state.dedup(df)) == want and shown(state.dedup(df, block=7)) == want
        cut = rng.randint(5, 35)
        first = state.dedup(df.where(f"arrival_seq < {cut}"), block=5)
        assert shown(state.dedup(df.where(f"arrival_seq >= {cut}"), first, block=3)) == want
    aged = state.age(state.dedup(occ(spark, [(1, 10, 1)])), 10**9, 1000, model.ERROR, inclusive=True)
    back = state.dedup(occ(spark, [(2, 50, 0)]), aged).first()
    assert (aged.first()["status"], back["status"], back["event_count"], back["uuid"]) == (model.AGED, model.NEW, 3, "u0")


def test_closed_occurrences_stay_apart(spark):
    rows = [(1, 10, 1), (1, 20, model.CLOSED), (1, 30, 0), (1, 40, model.CLOSED)]
    s = state.dedup(occ(spark, rows))
    assert sorted(
        (r["status"], r["event_count"]) for r in s.collect()
    ) == [(1, 2), (3, 1), (3, 1)] and s.select("fingerprint_hash").distinct().count() == 3


def test_clear_age_archive(spark):
    s = spark.createDataFrame(
        [("a", "h1", 10), ("b", "h1", 30), ("c", "h2", 5), ("d", "h1", 20)], "uuid string, clear_hash string, last_seen long"
    )
    c = spark.createDataFrame(
        [("h1", "x", 20), ("h1", "y", 25), ("h3", "z", 50), ("h1", "w", 20)], "clear_hash string, clear_uuid string, created long"
    )
    for block in (1, 7, 10**6):
        cleared = state.clear_marks(s, c, block)
        assert sorted(tuple(r) for r in cleared.collect()) == [("a", "w"), ("d", "w")]
    assert {
        r["uuid"]: r["status"] for r in state.apply_clears(s.withColumn("status", F.lit(0)), cleared).collect()
    } == {"a": model.CLEARED, "b": 0, "c": 0, "d": model.CLEARED}
    now, minute = 10**9, 60_000
    s = spark.createDataFrame(
        [(x, sev, 0, now - 5 * minute) for x, sev in (("w", 3), ("e", 4), ("i", 2))],
        "uuid string, severity int, status int, last_seen long"
    )
    aged = state.age(s, now, 4 * minute, model.ERROR)
    assert {r["uuid"] for r in aged.where(F.col("status") == model.AGED).collect()} == {"w", "i"}
    assert {r["uuid"] for r in state.age(s, now, 4 * minute, model.ERROR, limit=1).where(F.col("status") == model.AGED).collect()} == {"i"}
    stay, gone = state.archive_split(aged, now, 4 * minute)
    assert gone.count() == 2 and stay.count() == 1 and state.age(stay, now, 4 * minute, model.ERROR, True).first()["status"] == model.AGED


def test_reopening_restores_the_hash_of_a_long_fingerprint(spark):
    long = "f" * 400
    one = lambda u, st, h: (u, long, st, h, None, 0)
    plain = hashlib.sha1(long[:255].encode()).hexdigest()
    s = spark.createDataFrame(
        [one("a", 0, plain)], "uuid string, fingerprint string, status int, fingerprint_hash string, user_name string, status_change long"
    )
    closed = state.transition(s, s, model.CLOSED, 77)
    assert closed.first()["fingerprint_hash"] == hashlib.sha1((long[:255] + "|77").encode()).hexdigest()
    assert state.transition(closed, closed, model.NEW, 78).first()["fingerprint_hash"] == plain
    two = closed.union(closed.withColumn("uuid", F.lit("b")))
    assert sorted((r["uuid"], r["status"]) for r in state.transition(two, two, model.NEW, 78).collect()) == [("a", 0), ("b", 3)]
    held = closed.union(s.withColumn("uuid", F.lit("c")))
    assert sorted((r["uuid"], r["status"]) for r in state.transition(held, closed, model.NEW, 78).collect()) == [("a", 3), ("c", 0)]


def test_details_and_tags(spark):
    d = lambda n, v, m="REPLACE": (n, v, m)
    df = spark.createDataFrame(
        [([d("x", ["1", "2"]), d("y", ["3"])], [d("x", ["2", "9"]), d("z", ["4", "5"])])], f"old {details.DETAILS}, new {details.DETAILS}"
    )
    got = df.select(details.merge(F.col("old"), F.col("new")).alias("m")).first()["m"]
    assert [(x["name"], x["values"]) for x in got] == [("x", ["2", "9"]), ("y", ["3"]), ("z", ["4", "5"])]
    df = spark.createDataFrame(
        [([d("p", ["k"]), d("q", ["k"]), d("r", ["k"])], [d("p", ["k", "l"], "APPEND"), d("q", ["m", "k", "m"], "UNIQUE"), d("r", [])])],
        f"old {details.DETAILS}, new {details.DETAILS}"
    )
    got = df.select(details.merge(F.col("old"), F.col("new")).alias("m")).first()["m"]
    assert [(x["name"], x["values"]) for x in got] == [("p", ["k", "k", "l"]), ("q", ["k", "m"])]
    small = df.select(
        F.size(details.merge_within(F.col("old"), F.col("new"), 10, ("q",))).alias("n"),
        F.size(details.merge_within(F.col("old"), F.col("new"), 340, ("q",))).alias("some")
    ).first()
    assert small["n"] == 1 and small["some"] in (2, 3)
    tags = spark.createDataFrame(
        [([("site", ["n", "n"]), ("dev", ["m", "n"]), ("site", ["o"])],)], "t array<struct<type:string,uuids:array<string>>>"
    )
    assert [
        (x["type"], x["uuids"]) for x in tags.select(details.normalise_tags(F.col("t")).alias("n")).first()["n"]
    ] == [("dev", ["m"]), ("site", ["n", "o"])]


def plain_details(rows):
    """Details merged one occurrence after the other; rows are (created, [(name, values, merge)])."""
    out, last = {}, None
    for t, new in rows:
        late = last is not None and t < last
        last = t if not late else last
        if not new:
            continue
        base, onto = (out, new) if not late else ({n: (v, m) for n, v, m in new}, [(n, *x) for n, x in out.items()])
        base = dict(base)
        for n, v, m in onto:
            if m == "REPLACE":
                if v:
                    base[n] = (v, m)
                else:
                    base.pop(n, None)
            elif n not in base:
                base[n] = (v, m)
            else:
                was, kind = base[n]
                base[n] = (was + (v if m == "APPEND" else [x for x in dict.fromkeys(v) if x not in was]), kind)
        out = base
    return {n: v for n, (v, _) in out.items()}


def test_details_are_folded_as_one_by_one(spark):
    rng = random.Random(3)
    for case in range(5):
        made = lambda: [
            (
                n, [rng.choice("abc") for _ in range(rng.randint(0 if m == "REPLACE" else 1, 2))], m
            ) for n in rng.sample("xyz", rng.randint(0, 3)) for m in [rng.choice(["REPLACE", "REPLACE", "APPEND", "UNIQUE"])]
        ]
        rows = [(rng.randint(0, 30), made()) for _ in range(25)]
        if case < 4:  # late deletions leave an empty value of a kind that the model has no need of
            rows = [(t if case % 2 else i, [x for x in ds if x[1]] if case % 2 else ds) for i, (t, ds) in enumerate(rows)]
        else:
            rows = [(i, ds) for i, (t, ds) in enumerate(rows)]
        df = spark.createDataFrame(
            [(f"u{i}", i, 1, t, "/A", 4, 0, "h", "e", "f", ds) for i, (t, ds) in enumerate(rows)], OCC + f", details {details.DETAILS}"
        )
        got = state.dedup(df, block=4).first()["details"] or []
        assert {x["name"]: x["values"] for x in got} == plain_details(rows), case


def test_rollup_with_requested_tags(spark):
    rows = [("a", 3, 0, ["x", "y", "x"], 4), ("b", 3, 1, ["x"], 2), ("c", 5, 2, ["y"], 7), ("d", 5, model.CLOSED, ["x", "z"], 1)]
    df = spark.createDataFrame(rows, "uuid string, severity int, status int, tags array<string>, event_count long")
    shown = lambda out: {(r["tag"], r["severity"]): (r["events"], r["acknowledged"], r["total"]) for r in out.collect()}
    assert shown(reactions.tag_severities(df)) == {
        ("x", 3): (2, 1, 7), ("x", 5): (1, 0, 7), ("y", 3): (1, 0, 11), ("y", 5): (1, 0, 11), ("z", 5): (1, 0, 1)
    }
    open_ = EventFilter(status=model.OPEN_STATUSES)
    assert shown(reactions.tag_severities(df, open_, ["x", "z"])) == {("x", 3): (2, 1, 6), ("z", None): (0, 0, 0)}


def test_flaps_rise_over_the_threshold(spark):
    rows = [(0, 4), (1, 1), (2, 4), (3, 4), (4, 0), (5, 5), (400, 0), (401, 3), (401, 0), (401, 3)]
    df = spark.createDataFrame([(f"u{i}", i, 1, 1000 * t, "/A", sev, 0, "h", "e", "f") for i, (t, sev) in enumerate(rows)], OCC)
    for interval, want in ((300, [1, 0, 2, 0, 0, 3, 0, 1, 0, 2]), (3, [1, 0, 2, 0, 0, 2, 0, 1, 0, 2]), (1, [1, 0, 1, 0, 0, 1, 0, 1, 0, 2])):
        got = {r["uuid"]: r["n_flaps"] for r in reactions.flaps(df, "element_uuid", interval_s=interval).collect()}
        assert [got[f"u{i}"] for i in range(len(rows))] == want, interval


def test_heartbeats_at_the_boundary(spark):
    beats = spark.createDataFrame(
        [("m", "late", 0, 10), ("m", "due", 1000, 9), ("m", "fine", 1001, 9), ("m", "back", 5000, 9)],
        "monitor string, daemon string, last_time long, timeout_s int"
    )
    open_ = spark.createDataFrame([("m", "back"), ("m", "unknown"), ("m", "late")], "monitor string, daemon string")
    got = {r["daemon"]: r["action"] for r in reactions.heartbeats(beats, open_, 10_000).collect()}
    assert got == {"late": "error", "due": "error", "back": "clear", "unknown": "clear"}


def test_rules(spark):
    df = spark.createDataFrame(
        [("Pump 3 - over limit", "/Plant/Pump", 2, 8, ["/North", "/North/Hall"], "Pump Three", "valve-B Inlet")],
        "message string, event_class string, severity int, count int, groups array<string>, dev string, sub string"
    )
    cols = {
        "evt.message": F.col("message"), "evt.event_class": F.col("event_class"), "evt.severity": F.col("severity"),
        "evt.count": F.col("count"), "dev.groups": F.col("groups"), "dev.name": F.col("dev"), "sub_elem.name": F.col("sub")
    }
    true = [
        "2 == 2", "evt.message.endswith('limit')", "evt.severity < 3", "evt.event_class != '/Plant'", "evt.count >= 8",
        "'Three' in dev.name", "sub_elem.name.upper().startswith('VALVE')", '"/North" in dev.groups',
        "0 < evt.severity <= 2 and not evt.count == 9", "evt.count == 0 or evt.severity"
    ]
    false = [
        "2 = 2", "", "evt.colour == 'red'", "evt.count > 8", "evt.severity is 2", '"/Nor" in dev.groups', "open('x')", "[evt.count]",
        "evt.message.join()", "evt.count and 0"
    ]
    row = df.select(*(reactions.rule(r, cols).alias(f"r{i}") for i, r in enumerate(true + false))).first()
    assert list(row) == [True] * len(true) + [False] * len(false)


def test_signals_repeat_until_acknowledged(spark):
    spool = spark.createDataFrame(
        [("a", "s", 5, False), ("b", "s", 5, False), ("c", "s", 50, False)],
        "uuid string, subscription string, flush_time long, sent boolean"
    )
    subs = spark.createDataFrame([("s", "t", 60)], "subscription string, trigger string, repeat_seconds int")
    s = spark.createDataFrame([("a", 0), ("b", 1)], "uuid string, status int")
    signals, rest = reactions.flush(spool, subs, s, 10)
    assert {r["uuid"] for r in signals.collect()} == {"a", "b"}
    assert {r["uuid"]: r["flush_time"] for r in rest.collect()} == {"a": 60010, "b": -1, "c": 50}


def test_scalar_functions(spark):
    df = spark.createDataFrame([("héllo",)], "v string")
    assert [df.select(text.truncate_utf8(F.col("v"), n)).first()[0] for n in (1, 2, 3, 6, 9)] == ["h", "h", "hé", "héllo", "héllo"]
    assert df.select(text.organizer_ancestors(F.array(F.lit("/a/b/c"), F.lit("/a/x")))).first()[0] == ["/a", "/a/b", "/a/b/c", "/a/x"]
    assert df.select(text.routing_key(F.lit("/Sta tus/Ping"), "k.")).first()[0] == "k.sta_tus.ping"


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.sources import tables
    from tidemark.streaming.engine import SummaryTable

    e = tables.occurrences(spark, "/root/testdata/sf0.001").drop("detail_k", "tags")
    cut = [e.where(f"arrival_seq between {a} and {a + 332}") for a in (0, 333, 666)]
    src = tmp_path / "in"
    table = SummaryTable(spark, str(tmp_path / "out"))
    for part in cut:
        part.coalesce(1).write.mode("append").parquet(str(src))
        table.run(tables.stream(spark, str(src), e.schema), str(tmp_path / "cp")).awaitTermination()
    last = max(int(p.name[9:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("manifest="))
    cols = ["uuid", "fingerprint", "status", "event_count", "first_seen", "last_seen", "status_change"]
    got = sorted(tuple(r) for r in table.read(last).select(*cols).collect())
    n = e.where("arrival_seq < 999")
    assert got == sorted(tuple(r) for r in state.dedup(n).select(*cols).collect())


def test_stream_applies_clears_in_arrival_order(spark, tmp_path):
    from tidemark.streaming.engine import SummaryTable

    schema = OCC + ", clear_hash string, clear_hashes array<string>"
    row = lambda i, t, sev, f, h=None, hs=None: (f"u{i}", i, 1, t, "/A", sev, 0, "h", "e", f, h, hs)
    arrivals = [
        row(0, 10, 4, "f", "h1"), row(1, 15, 4, "g", "h1"), row(2, 30, 4, "x", "h2"),
        row(3, 14, 0, "c", hs=["h1"]),  # f only: g was seen later
        row(4, 20, 4, "f", "h1"),  # a new life of f
        row(5, 25, 0, "c", hs=["h1", "h2"]),  # f again and g; x was seen later
        row(6, 26, 0, "c", hs=["h1", "h9"]),  # nothing is open: dropped
        row(7, 40, 4, "f", "h1"), row(8, 50, 4, "m", "h3"), row(9, 60, 4, "m", "h4"),
        row(10, 70, 0, "c", hs=["h3"]),  # m has another hash by now: dropped
        row(11, 80, 0, "c", hs=["h4"]), row(12, 90, 4, "n", None), row(13, 95, 0, "c", hs=[]),
    ]
    want = {
        ("u0", "f", model.CLEARED, 1, "u3"), ("u1", "g", model.CLEARED, 1, "u5"), ("u4", "f", model.CLEARED, 1, "u5"),
        ("u2", "x", model.NEW, 1, None), ("u7", "f", model.NEW, 1, None),
        ("u8", "m", model.CLEARED, 2, "u11"), ("u12", "n", model.NEW, 1, None), ("u3", "c", model.CLOSED, 1, None),
        ("u5", "c", model.CLOSED, 1, None), ("u11", "c", model.CLOSED, 1, None),
    }
    for name, cuts in (("one", [0, 14]), ("two", [0, 4, 9, 14])):
        table = SummaryTable(spark, str(tmp_path / name))
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            table.fold(spark.createDataFrame(arrivals[a:b], schema), n)
        got = table.read(len(cuts) - 2)
        rows = [tuple(r) for r in got.select("uuid", "fingerprint", "status", "event_count", "cleared_by").collect()]
        assert len(rows) == len(want) and set(rows) == want
        assert got.select("fingerprint_hash").distinct().count() == len(want)


def test_stream_of_flaps_equals_batch(spark, tmp_path):
    from tidemark.sources import tables
    from tidemark.streaming import engine

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = [
        (
            f"u{i}", i, 1, 1000 * i * (1 if i < 60 else 40), "/A", (0, 4, 4, 0, 5, 2)[i * 7 % 6 if i % 5 else 0], 0, "h",
            None if i % 11 == 10 else f"e{i % 2}", "f"
        ) for i in range(120)
    ]
    df = spark.createDataFrame(rows, OCC)
    want = {(r["uuid"], r["n_flaps"]) for r in reactions.flap_alerts(reactions.flaps(df, "element_uuid", interval_s=300), 2).collect()}
    src = tmp_path / "in"
    for a in (0, 50, 100):
        df.where(f"arrival_seq between {a} and {a + 49}").coalesce(1).write.mode("append").parquet(str(src))
        alerts = engine.flap_alerts(tables.stream(spark, str(src), df.schema), "element_uuid", 2, interval_s=300)
        alerts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp")
        ).trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = [(r["uuid"], r["n_flaps"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_spool_state_machine(spark):
    """Every row of the survey's table, for r: (rule satisfied, subscription, spool before) -> (spool after, signal)."""
    now, never = 1_000_000, reactions.NEVER
    subs = [
        ("n", "t", 0, 0, False), ("nr", "t", 0, 60, False), ("i", "t", 0, 0, True), ("ir", "t", 0, 60, True), ("d", "t", 30, 0, False),
        ("di", "t", 30, 0, True), ("dr", "t", 30, 60, False)
    ]
    cases = [
        (False, "n", None, None, None), (False, "d", (5, False), (never, False), None), (False, "dr", (never, True), (never, True), None),
        (True, "n", None, (never, True), False), (True, "nr", None, (now + 60000, True), False), (True, "nr", (7, False), (7, True), False),
        (True, "n", (7, True), (7, True), False),
        (True, "i", None, (never, True), False), (True, "ir", None, (now + 60000, True), False),
        (True, "ir", (never, True), (now + 60000, True), None), (True, "ir", (7, True), (7, True), None),
        (True, "i", (never, True), (never, True), None),
        (True, "d", None, (now + 30000, False), None), (True, "dr", None, (now + 30000, False), None),
        (True, "d", (never, True), (now + 30000, True), None), (True, "d", (7, False), (7, False), None),
        (True, "di", (never, True), (never, True), None), (True, "dr", (now + 60001, True), (now + 60000, True), None),
        (True, "dr", (7, False), (7, False), None),
    ]
    # one event a case; of each, only the case's subscription counts
    uuids = [f"e{i}" for i in range(len(cases))]
    before = [(u, c[1], *c[2]) for u, c in zip(uuids, cases, strict=True) if c[2]] + [
        ("closed", "n", 5, True), ("closed", "d", 5, False), ("elsewhere", "d", 5, False), ("e0", "unknown", 5, False)
    ]
    events = [(u, 0) for u in uuids] + [("closed", model.CLOSED)]
    matches = [(u, "t") for u, c in zip(uuids, cases, strict=True) if c[0]] + [("closed", "t")]
    signals, spool = reactions.advance(
        spark.createDataFrame(events, "uuid string, status int"), spark.createDataFrame(matches, "uuid string, trigger string"),
        spark.createDataFrame(subs, "subscription string, trigger string, delay_seconds int, repeat_seconds int, send_initial boolean"),
        spark.createDataFrame(before, "uuid string, subscription string, flush_time long, sent boolean"), now,
    )
    after = {(r["uuid"], r["subscription"]): (r["flush_time"], r["sent"]) for r in spool.collect()}
    sent = {(r["uuid"], r["subscription"]): r["clear"] for r in signals.collect()}
    for u, (_, sub, _, want, signal) in zip(uuids, cases, strict=True):
        assert after.get((u, sub)) == want and sent.get((u, sub)) == signal, (u, sub)
    assert [k for k in after if k[0] == "closed"] == [] and {k: v for k, v in sent.items() if k[0] == "closed"} == {("closed", "n"): True}
    assert after["elsewhere", "d"] == (5, False) and after["e0", "unknown"] == (5, False)
    subs = spark.createDataFrame([("s", "t", 60)], "subscription string, trigger string, repeat_seconds int")
    due = spark.createDataFrame(
        [("a", "s", 5, True), ("gone", "s", 5, True)], "uuid string, subscription string, flush_time long, sent boolean"
    )
    none, rest = reactions.flush(due, subs, spark.createDataFrame([("a", model.CLOSED)], "uuid string, status int"), 10)
    assert none.count() == 0 and rest.count() == 0
