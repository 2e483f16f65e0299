"""Stored claims, and files imported once for each state."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatlake.operators import claims, store
from chatlake.sources import archives, exports
from chatlake.streaming import files, inbox

T0 = datetime(2025, 3, 1, 9)
CHECKED = "conversation string, segment long, nth int, content string, memory_type string, assertion_kind string, asserted_at timestamp, evidence array<struct<revision_id:string,start:int,end:int,quote:string>>, reason string"
TEXT = "I prefer tea in the morning and the boat leaks badly"


def proposed(spark, *rows):
    full = [("c", 0, i, text, kind, "self_report", T0 + timedelta(minutes=i), [(rev, a, b, "")] if rev else [], reason) for i, (text, kind, rev, a, b, reason) in enumerate(rows)]
    return spark.createDataFrame(full, CHECKED)


def test_claims_are_recorded_once(spark, tmp_path):
    held = claims.ClaimStore(spark, str(tmp_path / "claims"))
    revisions = spark.createDataFrame([(r, TEXT) for r in ("r1", "r2", "r3")], "revision_id string, text string")
    first = proposed(spark, ("I prefer tea in the morning", "preference", "r1", 0, 27, None), ("I prefer tea in the MORNING", "preference", "r2", 0, 27, None), ("the boat leaks", "project_fact", "r1", 32, 46, None), ("x", "goal", "r1", 0, 3, "span_mismatch"), ("out of range", "goal", "r1", 40, 400, None))
    assert claims.record(held, "run1", first, revisions, T0)["kind"] == "record"
    assert claims.record(held, "run1", first, revisions, T0) is None
    rows = {r.content: r for r in held.state().collect()}
    assert len(rows) == 3 and {r.status for r in rows.values()} == {"pending"}
    tea = next(r for r in rows.values() if "tea" in r.content)
    proof = lambda c: sorted((e.revision_id, e.quote) for e in held.table("evidence").filter(F.col("claim_id") == c).collect())
    assert proof(tea.claim_id) == [("r1", TEXT[:27]), ("r2", TEXT[:27])]
    assert proof(rows["out of range"].claim_id) == []
    second = proposed(spark, ("i prefer tea in the mornings", "preference", "r3", 2, 12, None), ("i prefer tea in the evening", "preference", "r3", 0, 8, None))
    claims.record(held, "run2", second, revisions, T0)
    assert held.table("claims").count() == 4  # one is new, one adds evidence
    assert proof(tea.claim_id) == [("r1", TEXT[:27]), ("r2", TEXT[:27]), ("r3", TEXT[2:12])]
    evening = held.table("claims").filter("content like '%evening%'").first().claim_id
    assert [(r.new_id, r.old_id, r.relation, r.status) for r in held.relations().collect()] == [(evening, tea.claim_id, None, "suggested")]
    answer = '```json\n{"relations": [{"index": 7, "relation_type": "same"}, {"index": 0, "relation_type": "nonsense"}, 5, {"index": 0, "relation_type": "contradicts"}, {"index": 0, "relation_type": "same"}]}\n```'
    pairs = spark.createDataFrame([("run2", 0, evening, tea.claim_id)], "run string, index int, new_id string, old_id string")
    named = claims.relation_answers(spark.createDataFrame([("run2", answer), ("run2", "not json")], "run string, answer string"), pairs)
    claims.name_relations(held, named, T0)
    assert held.relations().first().relation == "contradicts"
    both = spark.createDataFrame([(evening, tea.claim_id, "supersedes"), (tea.claim_id, evening, "supersedes")], "new_id string, old_id string, decision string")
    assert claims.decide(held, both, "me", T0).count() == 2
    assert claims.decide(held, both.filter(F.col("new_id") == evening), "me", T0).count() == 0
    status = {r.claim_id: r.status for r in held.state().collect()}
    assert (status[evening], status[tea.claim_id]) == ("approved", "superseded")
    claims.name_relations(held, named, T0)  # decided already
    assert (held.relations().first().relation, held.relations().first().status) == ("supersedes", "confirmed")
    boat = rows["the boat leaks"].claim_id
    claims.act(held, boat, "edit", "me", T0, "the boat is full of water")
    gone = spark.createDataFrame([("r1",)], "revision_id string")
    assert {r.claim_id: (r.status, r.content) for r in held.state(gone).collect()}[boat] == ("needs_review", "the boat is full of water")
    with pytest.raises(LookupError):
        claims.act(held, "nobody", "approve", "me", T0)
    with pytest.raises(ValueError, match="action"):
        claims.act(held, boat, "edit", "me", T0)


def test_two_runs_at_once(spark, tmp_path, monkeypatch):
    """The second run commits while the first is matched: the first finds the second's claim and adds its evidence to it."""
    held, revisions = claims.ClaimStore(spark, str(tmp_path / "claims")), spark.createDataFrame([("r1", TEXT), ("r2", TEXT)], "revision_id string, text string")
    rows = lambda rev: proposed(spark, ("i prefer tea", "preference", rev, 2, 12, None))
    plain, once = claims.facts.relation_candidates, []

    def meanwhile(new, old):
        if not once:
            once.append(1)
            claims.record(claims.ClaimStore(spark, held.root), "other", rows("r2"), revisions, T0)
        return plain(new, old)

    monkeypatch.setattr(claims.facts, "relation_candidates", meanwhile)
    claims.record(held, "mine", rows("r1"), revisions, T0)
    assert held.table("claims").count() == 1 and {r.revision_id for r in held.table("evidence").collect()} == {"r1", "r2"}
    assert held.table("runs").count() == 2


def test_changed_files_are_imported_once(spark, tmp_path):
    ledger, lake = files.Ledger(spark, str(tmp_path / "ledger")), store.Lake(spark, str(tmp_path / "lake"))
    box = tmp_path / "in"
    box.mkdir()
    talk = lambda i, text: f'[{{"conversation_id": "c{i}", "current_node": "n0", "mapping": {{"n0": {{"id": "n0", "message": {{"id": "m{i}", "author": {{"role": "user"}}, "update_time": {len(text)}, "content": {{"parts": ["{text}"]}}}}}}}}}}]'

    def put(i, text, at):
        (box / f"{i}.json").write_text(talk(i, text))
        os.utime(box / f"{i}.json", (at, at))

    broken = []

    def publish(paths, digest):
        rows = None
        for p in paths:
            one = archives.archive_elements(spark, p)
            rows = one if rows is None else rows.unionByName(one)
        job = store.publish(lake, exports.chat_export(spark, "", "me", rows.select("file", "value")), "chatgpt", "me", digest, T0)
        if broken:
            broken.pop()
            raise RuntimeError("power cut")
        return job

    for i in range(5):
        put(i, f"text {i}", 1000 + i)
    broken.append(1)
    run = lambda: [[os.path.basename(p) for p in part] for part in files.import_changed(ledger, str(box), publish, T0, most=2)]
    with pytest.raises(RuntimeError, match="power cut"):
        run()
    assert run() == [["0.json", "1.json"], ["2.json", "3.json"], ["4.json"]]
    assert [j["kind"] for j in lake.jobs()].count("duplicate") == 1  # the part that had been imported before the cut
    assert run() == []
    put(3, "text 3 changed", 2000)
    put(9, "new", 900)
    assert run() == [["9.json", "3.json"]]
    texts = lambda: sorted(r.text for r in lake.messages().select("text").collect())
    assert texts() == sorted([*(f"text {i}" for i in range(5)), "text 3 changed", "new"])
    assert ledger.seen().count() == 6 and lake.table("occurrences").count() == 7


def test_published_table_is_read_in_part(spark, tmp_path):
    """A batch in the order of its keys opens only what may hold them."""
    publish, path = inbox.publish_new(str(tmp_path / "out"), ["k"]), str(tmp_path / "out")
    frame = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    for a in range(0, 3000, 1000):
        publish(frame(a, a + 1000), 0)
    publish(frame(2500, 3500), 0)
    assert spark.read.parquet(path).count() == spark.read.parquet(path).select("k").distinct().count() == 3500
    plan = spark.read.parquet(path).filter(F.col("k").between(5000, 6000))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,5000)" in plan
    publish(spark.createDataFrame([(None, "x"), (7, "y")], "k long, v string"), 0)
    assert spark.read.parquet(path).filter("k = 7").count() == 1
