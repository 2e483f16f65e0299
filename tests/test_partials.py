"""Partial aggregates of an archive: equal to a scan after each kind of change, read without its messages, kept by backups."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatlake.operators import partials, retrieval, store

T0 = datetime(2025, 3, 1, 9)
NODES = "conversation string, title string, current_node string, node string, parent string, child_order long, event_id string, speaker string, created_at timestamp, updated_at timestamp, text string"
LIMITS = [{}, {"scopes": ["work"]}, {"deny": ["secret"]}, {"scopes": ["work", "home"], "deny": ["secret"], "classified": True}]


def talk(conv, texts, at, updated=None):
    """A message a day; the time of the last one isn't known."""
    return [(conv, "t", f"n{len(texts) - 1}", f"n{i}", f"n{i - 1}" if i else None, 0, f"chatgpt:me:{conv}-{i}", "owner", at + timedelta(days=i) if i < len(texts) - 1 else None, updated, t) for i, t in enumerate(texts)]


@pytest.fixture
def lake(spark, tmp_path):
    return store.Lake(spark, str(tmp_path / "lake"))


def put(spark, lake, rows, sha, namespace="me"):
    return store.publish(lake, spark.createDataFrame(rows, NODES), "chatgpt", namespace, sha, T0)


def same_as_scan(lake, limits=LIMITS):
    lake = lake.snapshot()
    assert partials.complete(lake)
    found, right = [], []
    for i, own in enumerate(limits):
        times = [F.min("created_at").alias("first"), F.max("created_at").alias("last")]
        scan = lake.messages(**own).groupBy("source_id").agg(F.count(F.lit(1)).alias("messages"), *times)
        found.append(partials.sources(lake, **own).withColumn("i", F.lit(i)))
        right.append(scan.withColumn("i", F.lit(i)))
    a, b = (sorted(map(tuple, union(x).select("i", "source_id", "messages", "first", "last").collect()), key=str) for x in (found, right))
    assert a == b
    return len(a)


def union(rows):
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out


def test_equal_to_a_scan_after_each_change(spark, lake, tmp_path):
    assert retrieval.covered(lake, None) == {"first": None, "last": None}
    put(spark, lake, talk("a", ["one", "two", "three"], T0) + talk("b", ["four", "five"], datetime(1969, 12, 31, 23)), "s0")
    assert same_as_scan(lake, LIMITS[:1]) == 1
    put(spark, lake, talk("c", ["six", "seven"], T0 - timedelta(days=400)), "s1", "you")
    store.label(lake, T0, ["work"], ["secret"], event="chatgpt:me:a-1")
    store.label(lake, T0, ["home", "work"], [], event="chatgpt:you:c-0")
    assert same_as_scan(lake) > 4
    # the earliest message goes: a least time can't be taken back, so its cell is made anew, and left with nothing
    gone = spark.createDataFrame([("chatgpt:me:b-0", "x")], "event_id string, reason string")
    store.withdraw_events(lake, gone, T0)
    assert same_as_scan(lake, LIMITS[:1]) == 2
    rows = lake.table("partials").filter("whole and messages = 0").collect()
    assert [r.day for r in rows] == [-1]
    assert retrieval.covered(lake, None)["first"] == T0 - timedelta(days=400)
    # changed content inherits the withdrawal and is added to cells that were made anew
    put(spark, lake, talk("b", ["four!", "five!"], datetime(1969, 12, 31, 23), T0) + talk("a", ["one!", "two!", "three!"], T0, T0), "s2")
    store.compact(lake, T0)
    assert len(lake.parts("partials")) == 1
    job = put(spark, lake, talk("d", ["eight", "nine"], T0 + timedelta(days=90)), "s3", "you")
    assert same_as_scan(lake) > 4
    assert retrieval.covered(lake, None)["last"] == T0 + timedelta(days=90)
    copy = store.Lake(spark, store.backup(lake, str(tmp_path / "backups"), T0)["path"])
    # the backup holds the whole log of policy in one change: what was withdrawn stays hidden there, too
    assert same_as_scan(copy, LIMITS[:1]) == 2
    b = F.col("event_id") == "chatgpt:me:b-0"
    assert copy.table("revisions").filter(b).count() == 2 and copy.messages().filter(b).isEmpty()
    store.withdraw_source(lake, job["source_id"], T0)
    assert same_as_scan(lake, LIMITS[:1]) == 1
    assert set(retrieval.brain_status(lake)["sources"]) == {r.source_id for r in lake.messages().select("source_id").distinct().collect()}


def test_no_message_is_read(spark, lake):
    put(spark, lake, talk("a", ["one", "two"], T0), "s0")
    state = lake.snapshot()
    folder = state.parts("revisions")[0][1]["path"]
    lake.delete(folder)
    assert retrieval.covered(state, None) == {"first": T0, "last": T0}
    assert retrieval.by_source(state, {"allow_scopes": ["work"]}) == {}


def test_an_archive_without_partials(spark, lake):
    """One of an older version is scanned until the next summary, which makes all partials."""
    put(spark, lake, talk("a", ["one", "two"], T0), "s0")
    old = [j | {"tables": {n: t for n, t in j["tables"].items() if n != "partials"}} for j in lake.jobs()]
    state = store.Lake(spark, lake.root, old)
    assert not partials.complete(state)
    assert retrieval.covered(state, None) == {"first": T0, "last": T0}
    assert partials.summed(state, 9).agg(F.sum("messages")).first()[0] == 2


def test_days_are_of_utc_whatever_the_zone(spark):
    micros = [-1_000_000, 0, 1_740_871_800_000_000]
    rows = spark.createDataFrame([(m,) for m in micros], "m long").select(F.timestamp_micros("m").alias("t")).select(partials.day_of("t").alias("d"))
    assert [r.d for r in rows.collect()] == [-1, 0, 20148]
