import pytest
from pyspark.sql import functions as F

from tidemark.operators import notes
from tidemark.operators.plugins import Plugin, apply, in_order


def plugin(name, *needs):
    return Plugin(name, lambda df, _: df.withColumn("seen", F.concat("seen", F.lit(name))), needs)


def test_order_cycles_and_missing():
    assert [p.name for p in in_order([plugin("a", "c"), plugin("b"), plugin("c", "b")])] == ["b", "c", "a"]
    assert [p.name for p in in_order([plugin("a"), plugin("b", "a"), plugin("c")], ["c"])] == ["a", "b"]
    for bad in ([plugin("a", "b"), plugin("b", "a")], [plugin("a", "x")]):
        with pytest.raises(ValueError):
            in_order(bad)


def test_apply_and_notes(spark):
    df = spark.createDataFrame(
        [("u", "", None, None), ("v", "", None, None)], f"uuid string, seen string, notes {notes.NOTES}, audit_log {notes.AUDIT}"
    )
    assert apply(df, [plugin("a", "b"), plugin("b")]).first()["seen"] == "ba"
    out = notes.add_note(notes.add_note(df, "u", "one", "x", "X", 1), "u", "two", "x", "X", 2)
    out = notes.audit(out, F.col("uuid") == "v", 3, "x", "X", 5)
    got = {r["uuid"]: r for r in out.collect()}
    assert [n["message"] for n in got["u"]["notes"]] == ["two", "one"] and got["v"]["notes"] is None
    assert got["v"]["audit_log"][0]["new_status"] == 3 and got["u"]["audit_log"] is None
