"""The stored archive, its queries, rules, sources, notes, claims and measuring, on small inputs of their own."""

import itertools
import json
import random
import sqlite3
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatlake.functions import text as X
from chatlake.operators import archive as A
from chatlake.operators import evaluation, extensions, facts, ids, policy, retrieval, rules, semantic, store, vault
from chatlake.sources import exports
from chatlake.sources import notes as note_source
from chatlake.streaming import inbox

T0 = datetime(2025, 3, 1, 9)
NODES = "conversation string, title string, current_node string, node string, parent string, child_order long, event_id string, speaker string, created_at timestamp, updated_at timestamp, text string"


def chain(conv, texts, at=T0, step=60, current=None, edit=()):
    out = []
    for i, (who, text) in enumerate(texts):
        changed = text + " changed" if i in edit else text
        out.append((conv, f"title {conv}", current or f"n{len(texts) - 1}", f"n{i}", f"n{i - 1}" if i else None, 0, f"chatgpt:me:{conv}-{i}", who, at + timedelta(seconds=step * i) if at else None, at + timedelta(days=1) if i in edit else None, changed))
    return out


TALKS = [
    *chain("a", [("owner", "shall we plant tomatoes in the garden"), ("assistant", "tomatoes like sun"), ("owner", "and beans"), ("assistant", "beans climb"), ("owner", "the garden is small, my token = abcdefgh12345678")]),
    *chain("b", [("owner", "the boat leaks"), ("assistant", "tar the boat"), ("owner", "tomatoes again")], T0 + timedelta(days=2)),
    *chain("c", [("owner", "undated tomatoes")], None),
    *chain("d", [("owner", "root"), ("assistant", "left tomatoes")], T0 + timedelta(days=3), current="n9"),
]


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    lake = store.Lake(spark, str(tmp_path_factory.mktemp("lake")))
    store.publish(lake, spark.createDataFrame(TALKS, NODES), "chatgpt", "me", "sha1", T0)
    return lake


def test_import_again_and_edited(spark, lake):
    assert store.publish(lake, spark.createDataFrame(TALKS, NODES), "chatgpt", "me", "sha1", T0)["kind"] == "duplicate"
    edited = chain("b", [("owner", "the boat leaks"), ("assistant", "tar the boat"), ("owner", "tomatoes again")], T0 + timedelta(days=2), edit={1})
    before = lake.table("revisions").count()
    store.publish(lake, spark.createDataFrame(edited, NODES), "chatgpt", "me", "sha2", T0 + timedelta(days=5))
    assert lake.table("revisions").count() == before + 1
    assert lake.table("occurrences").count() == before + 3
    now = {r.event_id: r.current_revision_id for r in lake.current().collect()}
    text = {r.revision_id: r.text for r in lake.table("revisions").collect()}
    assert text[now["chatgpt:me:b-1"]] == "tar the boat changed"
    assert lake.path_unknown() == 1
    assert set(store.restore_check(lake).values()) == {0}
    assert store.status(lake)["jobs"] == {"complete": 3, "partial": 0, "failed": 0}
    with pytest.raises(ValueError, match="namespace"):
        store.publish(lake, spark.createDataFrame(TALKS, NODES), "chatgpt", "not ok", "x", T0)


def test_failed_import_leaves_nothing_visible(spark, tmp_path):
    lake = store.Lake(spark, str(tmp_path))
    bad = spark.createDataFrame(TALKS, NODES).withColumn("text", F.when(F.col("conversation") == "c", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        store.publish(lake, bad, "chatgpt", "me", "s", T0)
    assert [j["status"] for j in lake.jobs()] == ["failed"]
    assert lake.table("revisions").count() == 0


def test_search_pages_and_recall(lake):
    every, cursor = [], None
    while True:
        page = retrieval.search_history(lake, "tomatoes", order="chronological", limit=2, cursor=cursor)
        every += [r["event_id"] for r in page["results"]]
        cursor = page["next_cursor"]
        if not cursor:
            break
    assert every == [f"chatgpt:me:{x}" for x in ("a-0", "a-1", "b-2", "d-1", "c-0")]
    assert page["total"] == 5
    assert page["undated"] == 1
    back = retrieval.search_history(lake, "tomatoes", order="reverse", limit=10)["results"]
    assert [r["event_id"][11:] for r in back] == ["d-1", "b-2", "a-1", "a-0", "c-0"]
    assert [r["event_id"][11:] for r in retrieval.search_history(lake, "tomatoes", branch="selected")["results"]] == ["a-0", "a-1", "b-2", "c-0"]
    one = retrieval.search_history(lake, "garden small", mode="all_terms", redact=True)
    assert "abcdefgh12345678" not in one["results"][0]["snippet"]
    assert one["warnings"] == ["credentials are masked"]
    assert one["results"][0]["node"] == "a::n4"
    with pytest.raises(ValueError, match="empty"):
        retrieval.search_history(lake, "")
    with pytest.raises(ValueError, match="gone"):
        retrieval.search_history(lake, "tomatoes", cursor=retrieval.encode([False, 1, "nobody", "no revision"]))
    with pytest.raises(ValueError, match="not a cursor"):
        retrieval.search_history(lake, "tomatoes", cursor="no cursor")
    with pytest.raises(retrieval.QueryTooBroad):
        retrieval.search_history(lake, "tomatoes", max_scan=3)
    found = retrieval.recall(lake, "tomatoes", radius=1, budget=200)
    assert [s["conversation"] for s in found["results"]] == ["a", "b", "d"]
    assert [m["event_id"][-3:] for m in found["results"][0]["messages"]] == ["a-0", "a-1", "a-2"]
    tight = retrieval.recall(lake, "tomatoes", radius=1, budget=60)
    assert tight["budget"]["used"] <= 60
    assert tight["truncated"]


def test_fitting_a_fragment():
    m = lambda t, hit: {"text": t, "is_hit": hit}
    shown, used = retrieval.fitted([m("ab", False), m("cdef", True), m("ghij", False), m("k", False)], 8)
    assert (used, [x["text"] for x in shown]) == (6, ["ab", "cdef"])
    shown, used = retrieval.fitted([m("abcdef", True)], 4)
    assert shown[0] == {"text": "abcd", "is_hit": True, "truncated": True, "text_offset": 4}


def test_event_timeline_and_citations(spark, lake):
    e = retrieval.get_event(lake, "chatgpt:me:b-1", radius=1, text_limit=5)
    assert (e["text"], e["next_offset"], len(e["versions"])) == ("tar t", 5, lake.table("revisions").filter("event_id = 'chatgpt:me:b-1'").count())
    assert [c["event_id"][-3:] for c in e["context"]] == ["b-0", "b-2"]
    assert retrieval.resolve_citation(lake, e["citation"])["event_id"] == "chatgpt:me:b-1"
    assert retrieval.resolve_citation(lake, "pb:no") is None
    with pytest.raises(LookupError):
        retrieval.get_event(lake, "chatgpt:me:nobody")
    days = {(str(r.day), r.conversation): (r.n, r.n_owner, r.line) for r in retrieval.timeline(lake, "UTC").collect()}
    assert days["2025-03-01", "a"] == (5, 3, "shall we plant tomatoes in the garden")
    assert days["2025-03-03", "b"] == (3, 2, "the boat leaks")
    recent = retrieval.recent_events(lake, T0 + timedelta(days=3, hours=1), days=1, limit=1)
    assert recent["results"][0]["event_id"] == "chatgpt:me:d-1"
    again = retrieval.recent_events(lake, T0 + timedelta(days=3, hours=1), days=1, limit=1, cursor=recent["next_cursor"])
    assert again["results"][0]["event_id"] == "chatgpt:me:d-0"
    assert retrieval.brain_status(lake)["warnings"] == []
    assert retrieval.show_event(lake, "chatgpt:me:b-1").count() == len(e["versions"])


def test_policy_hides_and_inherits(spark, tmp_path):
    lake = store.Lake(spark, str(tmp_path))
    store.publish(lake, spark.createDataFrame(TALKS, NODES), "chatgpt", "me", "s1", T0)
    lab = policy.relabel(lake.table("policy"), lake.table("revisions"), 2, T0, ["garden"], [], event="chatgpt:me:a-0")
    store.change_policy(lake, lab, T0, "label")
    store.change_policy(lake, policy.withdraw(lake.table("policy"), lake.table("revisions"), 3, T0, event="chatgpt:me:b-2"), T0, "withdraw")
    assert policy.withdraw(lake.table("policy"), lake.table("revisions"), 4, T0, event="chatgpt:me:b-2").count() == 0
    seen = lambda p: [r["event_id"][11:] for r in retrieval.search_history(lake, "tomatoes", profile=p)["results"]]
    assert seen({"allow_scopes": ["*"], "allow_unclassified": True}) == ["a-0", "a-1", "d-1", "c-0"]
    assert seen({"allow_scopes": ["garden"]}) == ["a-0"]
    assert seen({"allow_scopes": []}) == []
    edited = chain("b", [("owner", "the boat leaks"), ("assistant", "tar the boat"), ("owner", "tomatoes again")], T0 + timedelta(days=2), edit={2})
    store.publish(lake, spark.createDataFrame(edited, NODES), "chatgpt", "me", "s2", T0)
    assert "b-2" not in seen({"allow_scopes": ["*"], "allow_unclassified": True})
    with pytest.raises(LookupError):
        retrieval.get_event(lake, "chatgpt:me:b-2")
    with pytest.raises(ValueError, match="withdrawn"):
        policy.relabel(lake.table("policy"), lake.table("revisions"), 9, T0, ["x"], [], event="chatgpt:me:b-2")
    counter = itertools.count()
    with pytest.raises(RuntimeError):
        policy.with_epoch_retry(lambda: next(counter), lambda: 1)
    assert policy.with_epoch_retry(lambda: policy.epoch_of(lake.table("policy")), lambda: "done") == "done"


def test_visible_is_closed_without_a_row(spark):
    rows = spark.createDataFrame([("r1", "s"), ("r2", "s")], "revision_id string, source string")
    log = spark.createDataFrame([("r1", True, [], [])], "revision_id string, available boolean, scopes array<string>, sensitivity array<string>")
    assert [r.revision_id for r in A.visible(rows, log).collect()] == ["r1"]
    assert A.visible(rows, log, classified=True).count() == 0
    assert A.visible(rows, scopes=["a"]).count() == 0


def test_backups(spark, lake, tmp_path):
    folder = str(tmp_path / "backups")
    made = [store.backup(lake, folder, T0 + timedelta(days=i)) for i in range(3)]
    assert store.backup_check(spark, made[0]["path"])
    gone = store.prune_backups(spark, folder, 1, protect=[made[0]["path"].rsplit("/", 1)[-1]])
    assert [g.rsplit("/", 1)[-1] for g in gone] == [made[1]["path"].rsplit("/", 1)[-1]]


def test_semantic_index(spark, lake):
    provider = semantic.HashEmbedding()
    a, b = provider.embed(["我要找工作", "写一封求职信"])
    assert sum(x * y for x, y in zip(a, b, strict=True)) > 0.3
    assert provider.embed([""]) == [[0.0] * 256]
    rows = lake.indexable()
    assert rows.filter("text like '%token =%'").count() == 0
    none = spark.createDataFrame([], "revision_id string, digest string, chunk int, start long, end long, embedding array<double>")
    vectors = semantic.reindexed(none, rows, provider)
    assert semantic.index_sizes(vectors, rows).first().missing == 0
    changed = rows.withColumn("text", F.when(F.col("event_id") == "chatgpt:me:a-2", F.lit("and peas")).otherwise(F.col("text")))
    digest = F.sha2("text", 256).alias("digest")
    lacking, stale = semantic.pending(changed.select("revision_id", digest), vectors.select("revision_id", "digest").distinct())
    assert lacking.count() == stale.count() == 1
    assert semantic.reindexed(vectors, changed, provider).select("revision_id").distinct().count() == rows.count()
    hit = retrieval.search_history(lake, "tomatoes", order="relevance", vectors=vectors, provider=provider, limit=10)["results"]
    assert {h["kind"] for h in hit} <= {"exact", "both", "semantic"}
    assert {h["event_id"][11:] for h in hit} >= {"a-0", "a-1", "b-2", "c-0", "d-1"}
    bits = spark.createDataFrame([([1.0, -1.0] * 32, [1.0] * 64)], "a array<double>, b array<double>")
    assert bits.select(semantic.bit_distance(semantic.packed_bits(F.col("a")), semantic.packed_bits(F.col("b"))).alias("d")).first().d == 32
    assert spark.range(1).select(semantic.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first().c == 0
    assert ids.index_version({"a": 1}) != ids.index_version({"a": 1}, "int8")[:16] + "x"


def test_rules(spark):
    cases = [
        ("codex", "  # AGENTS.md instructions\nx", None, "codex_agents_md"), ("claude", "# AGENTS.md instructions\nx", "# AGENTS.md instructions\nx", None),
        ("claude", "<system-reminder>a</system-reminder>  hello", "hello", None), ("claude", "<command-name>a</command-name>\n<system-reminder x=1>b</system-reminder>", None, "command_name_block"),
        ("dsh", "see <system-reminder>a</system-reminder>", "see <system-reminder>a</system-reminder>", None), ("claude", "<system-reminder>open", "<system-reminder>open", None),
        ("dsh", "<environment_context>e</environment_context>Current runtime context\nx", None, "dsh_runtime_context"), ("codex", "   ", None, None), ("codex", "plain", "plain", None),
    ]
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _, _) in enumerate(cases)], "i int, source string, text string")
    got = {r.i: (r.clean, r.rule) for r in rules.cleaned(df).collect()}
    assert got == {i: (c, r) for i, (_, _, c, r) in enumerate(cases)}
    meta = ['{"source": {"subagent": {"other": "g"}}}', '{"source": {"cli": "x"}}', '{"isMeta": true}', '{"isSidechain": false}', "{}"]
    df = spark.createDataFrame([(i, "codex" if i < 2 else "claude", m) for i, m in enumerate(meta)], "i int, s string, m string")
    assert [r[0] for r in df.orderBy("i").select(rules.metadata_rule(F.col("s"), F.col("m"))).collect()] == ["codex_subagent_source", None, "claude_is_meta", None, None]
    for raw, want in (("你说\nabc\nabc", "abc"), ("你说 abc\nabc", "abc"), ("你说得对,abc", "你说得对,abc"), ("abc abc", "abc abc"), ("你说：\nabc", "abc"), ("你说", "")):
        assert rules.without_label(raw) == want
    m = spark.createDataFrame([("e1", "codex", "c1", "owner", "The following is the Codex agent history\n", T0), ("e2", "codex", "c1", "owner", "mine", T0), ("e3", "gemini", "c2", "owner", "你说\nabc\nabc", None), ("e4", "codex", "codex-123456789012", "owner", "copy", T0), ("e5", "codex", "c3", "assistant", "x", T0)], "event_id string, source string, conversation string, speaker string, text string, created_at timestamp")
    threads = spark.createDataFrame([("aaaa-123456789012",)], "imported_thread_id string")
    found = rules.plan(m, threads=threads)
    assert {r.event_id: r.rule for r in found.collect()} == {"e1": "codex_guardian_history", "e2": "codex_guardian_history", "e3": "gemini_label_dup", "e4": "codex_imported_thread"}
    after = {r.source: (r.current, r.removed, r.unknown_removed) for r in rules.before_and_after(m, found, F.lit(T0)).collect()}
    assert after == {"codex": (3, 3, 0), "gemini": (0, 0, 1)}
    assert rules.samples(found, 1).count() == 3


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\nnot json\n")


def test_sources(spark, tmp_path):
    node = lambda parent, role, parts, kids=(), **kw: {"parent": parent, "children": list(kids), "message": {"author": {"role": role}, "content": {"parts": parts}, **kw}}
    talk = {"title": "t", "current_node": "b", "mapping": {"root": {"parent": None, "children": ["a", "b"], "message": None}, "a": node("root", "user", ['{"json": 1}', {"asset_pointer": "p"}, {"x": 1}, "", "second"], create_time=1.5), "b": node("root", "assistant", [{"text": "object"}]), "bad": 3}}
    for name, doc in (("list", [talk]), ("wrapped", {"conversations": [talk, {"title": "none"}]}), ("other", {"x": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "broken.json").write_text("{")
    for name in ("list", "wrapped"):
        got = {r.node: r for r in exports.chat_export(spark, str(tmp_path / f"{name}.json"), "ns").collect()}
        assert set(got) == {"root", "a", "b"}
        assert (got["a"].text, got["a"].attachments, got["a"].n_unsupported, got["a"].child_order) == ('{"json": 1}\nsecond', "p", 1, 0)
        assert (got["b"].text, got["b"].child_order, got["root"].event_id) == (None, 1, None)
        assert got["a"].conversation.startswith("conv-fb-")
    errors = {(r.file.rsplit("/", 1)[-1], r.error) for r in exports.export_errors(spark, str(tmp_path / "*.json")).collect()}
    assert errors == {("broken.json", "MEMBER_NOT_JSON"), ("other.json", "NO_CONVERSATION_DATA"), ("wrapped.json", "UNSUPPORTED_CONVERSATION"), ("list.json", "UNSUPPORTED_NODE"), ("wrapped.json", "UNSUPPORTED_NODE")}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("conversations.json", json.dumps([talk]))
        z.writestr("file.dat", b"\0\1")
    members = exports.archive_members(spark, str(tmp_path / "x.zip"))
    assert {r.member: r.kind for r in members.collect()} == {"conversations.json": "conversations", "file.dat": "attachment"}
    assert exports.archive_sha(members).count() == 1
    read = members.filter("kind = 'conversations'").select(F.col("member").alias("file"), F.col("content").cast("string").alias("value"))
    assert exports.chat_export(spark, "", "ns", read).count() == 3
    for name in ("../x", "/x", "C:/x", "a//b", "~/x", "a/./b"):
        with pytest.raises(exports.ArchiveRejected):
            exports.check_member(name)
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("zeros", b"\0" * 2_000_000)
    with pytest.raises(Exception, match="too large"):
        exports.archive_members(spark, str(tmp_path / "bomb.zip")).count()


def test_session_sources(spark, tmp_path):
    item = lambda role, text, t: {"timestamp": t, "type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "x", "text": text}, {"image": 1}]}}
    write(tmp_path / "rollout-1-abc.jsonl", [{"type": "session_meta", "payload": {"source": {"cli": 1}}}, item("user", "# AGENTS.md instructions\n", "2025-01-01T00:00:00Z"), item("user", "real question", "2025-01-01T00:00:01Z"), item("assistant", "answer", 1735689605000)])
    write(tmp_path / "rollout-1-sub.jsonl", [{"type": "session_meta", "payload": {"source": {"subagent": "x"}}}, item("user", "hidden", "2025-01-01T00:00:00Z")])
    got = exports.codex_sessions(spark, str(tmp_path / "rollout*.jsonl")).orderBy("created_at").collect()
    assert [(r.conversation, r.title, r.text, r.parent is None) for r in got] == [("codex-abc", "codex: real question", "real question", True), ("codex-abc", "codex: real question", "answer", False)]
    assert got[1].parent == got[0].node
    assert got[1].created_at == datetime(2025, 1, 1, 0, 0, 5)
    line = lambda kind, content, **kw: {"type": kind, "sessionId": "s1", "uuid": f"u{content}", "timestamp": "2025-01-01T00:00:00Z", "message": {"role": kind, "content": content}, **kw}
    write(tmp_path / "claude.jsonl", [line("user", "q"), line("user", "m", isMeta=True), line("assistant", [{"type": "text", "text": "a"}, {"type": "tool_use"}]), {"type": "summary"}])
    assert [r.text for r in exports.claude_sessions(spark, str(tmp_path / "claude.jsonl")).orderBy(F.col("parent").isNotNull()).collect()] == ["q", "a"]
    write(tmp_path / "dsh.jsonl", [{"type": "session", "id": "d1"}, {"type": "session/title", "data": {"title": "T"}}, {"type": "user/message", "time": 1735689600, "seq": 1, "data": {"content": "q"}}, {"type": "assistant/message", "time": 1735689601, "seq": 2, "data": {"message": {"content": ["a", {"text": "b"}]}}}])
    assert [(r.title, r.text) for r in exports.dsh_sessions(spark, str(tmp_path / "dsh.jsonl")).orderBy("created_at").collect()] == [("T", "q"), ("T", "a\nb")]
    db = sqlite3.connect(tmp_path / "h.db")
    db.execute("CREATE TABLE sessions (id, title, display_name, started_at)")
    db.execute("CREATE TABLE messages (id INTEGER, session_id, role, content, timestamp)")
    db.execute("INSERT INTO sessions VALUES ('x', '', 'shown', 0)")
    db.executemany("INSERT INTO messages VALUES (?, 'x', ?, ?, ?)", [(1, "user", "q", 1735689600), (2, "assistant", '[{"text": "a"}]', 1735689601), (3, "tool", "t", 1)])
    db.commit()
    db.close()
    assert [(r.conversation, r.title, r.text) for r in exports.hermes_sessions(spark, str(tmp_path / "h.db")).orderBy("created_at").collect()] == [("hermes-x", "shown", "q"), ("hermes-x", "shown", "a")]
    (tmp_path / "g.json").write_text(json.dumps({"conversations": [{"id": "g", "title": "T", "created_at": 1735689600, "turns": [{"role": "user", "text": "你说\nhi\nhi"}, {"role": "assistant", "text": "yes"}]}, {"id": "u", "turns": [{"role": "user", "text": "x"}]}]}))
    assert [(r.conversation, r.text, r.created_at is None) for r in exports.gemini_export(spark, str(tmp_path / "g.json")).orderBy("conversation", "created_at").collect()] == [("gemini-g", "hi", False), ("gemini-g", "yes", False), ("gemini-u", "x", True)]
    assert exports.known_threads(spark, str(tmp_path / "no.json")).count() == 0
    one = exports.write_batch(str(tmp_path / "in"), "s", "[]", "20250101T000000")
    assert exports.write_batch(str(tmp_path / "in"), "s", "[]", "20250102T000000") == one


def test_notes_and_vault(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.md").write_text("Intro\n\n# First\ntext about Straße\n```\n# no\n```\nSecond\n---\nstrasse again\n")
    (tmp_path / "two.md").write_text("nothing\n")
    (tmp_path / "password.md").write_text("strasse\n")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    every = note_source.notes(spark, str(tmp_path))
    assert {r.path: r.skipped for r in every.collect()} == {"a/one.md": None, "two.md": None, "password.md": None, "bad.md": "not_utf8"}
    rows = vault.listed(every.filter("skipped is null"))
    assert {r.path for r in rows.collect()} == {"a/one.md", "two.md"}
    assert vault.listed(every, exclude=["a"]).filter("path like 'a/%'").count() == 0
    assert [r.path for r in vault.listed(every, include=["a/**"]).collect()] == ["a/one.md"]
    assert {r.path: r.title for r in vault.titles(rows).collect()} == {"a/one.md": "First", "two.md": "two"}
    assert [(r.line, r.level, r.heading) for r in vault.headings(rows).orderBy("line").collect()] == [(3, 1, "First"), (8, 2, "Second")]
    hit = vault.search(rows, "STRASSE", width=20).collect()
    assert [(h.path, h.line_start, h.title) for h in hit] == [("a/one.md", 4, "First")]
    assert len(hit[0].snippet) <= 20
    page = vault.note(rows, "a/one.md", start=9, lines=2)
    assert (page["lines"], page["heading"], page["next"]) == (["---", "strasse again"], "Second", 11)
    with pytest.raises(ValueError, match="date"):
        vault.note(rows, "a/one.md", revision="old")
    with pytest.raises(LookupError):
        vault.note(rows, "none.md")
    for t, a, b, n in (("abcdefghij", 4, 6, 5), ("abcdefghij", 0, 9, 4), ("ab", 0, 1, 5), ("abcdefghij", 9, 10, 4)):
        assert len(vault.bounded(t, a, b, n)) <= n


def plain_segments(rows, chars, gap, carried):
    """The same rule, message by message, in plain Python."""
    out, cur = [], []
    for t, rid, who, text in rows:
        for test in (lambda t=t: t - cur[-1][0] > gap, lambda text=text: sum(len(m[3]) for m in cur) + len(text) > chars):
            if cur and test():
                out.append(list(cur))
                cur = [(*m[:4], "context") for m in cur[-carried:]]
        if all(m[1] != rid for m in cur):
            cur.append((t, rid, who, text, "support"))
    out.append(cur)
    return [s for s in out if any(m[2] == "owner" and m[4] == "support" for m in s)]


def test_segments_and_claims(spark):
    r = random.Random(4)
    talks = {c: sorted((r.randint(0, 40_000), f"{c}{i:03d}", r.choice(["owner", "assistant"]), "x" * r.randint(1, 400)) for i in range(40)) for c in "pqr"}
    df = spark.createDataFrame([(c, rid, who, T0 + timedelta(seconds=t), text) for c, rows in talks.items() for t, rid, who, text in rows], "conversation string, revision_id string, speaker string, created_at timestamp, text string")
    got = facts.segments(df, 900, 3600, 3)
    for c, rows in talks.items():
        want = [[(m[1], m[4]) for m in s] for s in plain_segments(rows, 900, 3600, 3)]
        mine = {}
        for x in got.filter(F.col("conversation") == c).orderBy("segment", "place").collect():
            mine.setdefault(x.segment, []).append((x.revision_id, x.role))
        assert list(mine.values()) == want
    assert facts.estimate(got).first().segments == sum(len(plain_segments(rows, 900, 3600, 3)) for rows in talks.values())
    seg = spark.createDataFrame([("c", 0, 0, "r1", "owner", T0, "I prefer Tea in the Morning", "support"), ("c", 0, 1, "r2", "assistant", T0, "you like tea", "support"), ("c", 0, 2, "r3", "owner", T0, "old words", "context")], got.schema)
    claim = lambda content, evidence, t="preference", k="self_report": {"content": content, "memory_type": t, "assertion_kind": k, "evidence": evidence}
    ev = lambda rid, q: {"revision_id": rid, "quote": q}
    answer = {"claims": [claim("likes tea", [ev("r1", "prefer tea")]), claim("", []), claim("x" * 301, []), claim("a", [], "mood"), claim("a", [], k="gossip"), claim("a", []), claim("a", [ev("r2", "like")]), claim("a", [ev("r1", "coffee")]), claim("a", [ev("r3", "old")]), claim("a", [ev("r9", "x")]), 7]}
    rows = facts.proposals(spark, spark.createDataFrame([("c", 0, f"```json\n{json.dumps(answer)}\n```")], "conversation string, segment long, answer string"))
    out = facts.validated(rows, seg).orderBy("nth").collect()
    assert [o.reason for o in out] == [None, "bad_shape", "content_too_long", "invalid_memory_type", "invalid_assertion_kind", "no_evidence", "assistant_only_evidence", "span_mismatch", "no_evidence", "no_evidence", "bad_shape"]
    assert out[0].evidence[0].quote == "prefer Tea"
    assert {x.reason: x.n for x in facts.rejections(facts.validated(rows, seg)).collect()}["bad_shape"] == 2
    assert facts.quote_span("Straße nach Bern", "STRASSE") == (0, 6)
    key, checked = facts.run_extraction(seg, lambda prompt: json.dumps({"claims": []}), set(), "p", "m")
    assert checked.count() == 0
    assert facts.run_extraction(seg, None, {key}, "p", "m") == (key, None)
    with pytest.raises(ValueError):
        facts.model_json("[1]")


def test_claim_similarity_review_and_relations(spark):
    texts = ["i prefer tea in the morning", "i prefer tea in the mornings", "i prefer tea at night", "the boat leaks", "the boat leaks badly", "quite another thing"]
    bi = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} or {t}
    df = spark.createDataFrame([(f"c{i}", "goal", t, t, T0 + timedelta(seconds=i)) for i, t in enumerate(texts)], "claim_id string, memory_type string, content string, search string, created_at timestamp")
    want = {(f"c{i}", f"c{j}") for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and len(bi(a) & bi(b)) >= 0.45 * len(bi(a) | bi(b))}
    assert {(r.new_id, r.old_id) for r in facts.similar_claims(df, df).collect()} == want
    new, old = df.filter("claim_id = 'c1'"), df.filter("claim_id <> 'c1'")
    assert [r.same_as for r in facts.merged(new, old).collect()] == ["c0"]
    assert facts.relation_candidates(df.filter("claim_id = 'c4'"), old).count() == 1
    claims = df.select("claim_id", "memory_type", "content", F.col("created_at").alias("asserted_at"))
    acts = spark.createDataFrame([("c0", 1, "approve", "me", None), ("c3", 2, "reject", "me", None), ("c4", 3, "edit", "me", "it leaks"), ("c5", 4, "skip", "me", None)], "claim_id string, seq long, action string, actor string, content string")
    ev = spark.createDataFrame([("c0", "r1", 0, 5), ("c4", "r2", 0, 3)], "claim_id string, revision_id string, start int, end int")
    gone = spark.createDataFrame([("r1",)], "revision_id string")
    state = facts.states(claims, acts, gone, ev)
    assert {r.claim_id: (r.status, r.content) for r in state.collect() if r.claim_id in ("c0", "c3", "c4", "c5")} == {"c0": ("needs_review", texts[0]), "c3": ("rejected", texts[3]), "c4": ("approved", "it leaks"), "c5": ("pending", texts[5])}
    assert [r.claim_id for r in facts.pending_claims(state).collect()] == ["c1", "c2", "c5", "c0"]
    rel = spark.createDataFrame([("c2", "c1", "supersedes", "confirmed"), ("c1", "c0", "supersedes", "confirmed")], "new_id string, old_id string, relation string, status string")
    assert facts.leads_to(rel, "c2", "c0")
    with pytest.raises(ValueError, match="circle"):
        facts.decide(rel, "c0", "c2", "supersedes", 9, "me", T0)
    row, done = facts.decide(rel, "c4", "c3", "supersedes", 9, "me", T0)
    assert [(a["claim_id"], a["action"]) for a in done] == [("c4", "approve"), ("c3", "supersede")]
    assert facts.decide(rel, "c4", "c3", "reject_new", 9, "me", T0)[0]["status"] == "dismissed"
    listed = {r.claim_id: (r.n_evidence, r.superseded_by) for r in facts.list_claims(state, ev, rel).collect()}
    assert listed["c0"] == (1, "c1")
    assert facts.resolve_claim(claims, "c3") == "c3"
    with pytest.raises(LookupError):
        facts.resolve_claim(claims, "c")
    section = facts.profile_section(state)
    assert section == "## goal\n- it leaks"
    once = facts.with_section("top\n", section)
    assert facts.with_section(once, section) == once
    m = spark.createDataFrame([("r1", "e", T0, "hello world")], "revision_id string, event_id string, created_at timestamp, text string")
    assert facts.explained(state, ev, rel, m, "c0")["evidence"].first().quote == "hello"
    assert facts.evidence_rows(spark.createDataFrame([("c0", [("r1", 0, 5, ""), ("r1", 3, 99, "")])], "claim_id string, evidence array<struct<revision_id:string,start:int,end:int,quote:string>>"), m).count() == 1


def test_evaluation_and_collecting(spark, lake):
    suite = evaluation.load_suite(json.dumps({"schema_version": "1", "name": "s", "requires": {"messages": 3}, "cases": [{"id": "1", "type": "search", "query": "boat", "acceptable_event_ids": ["chatgpt:me:b-0"]}, {"id": "2", "type": "refusal", "query": "zeppelin"}, {"id": "3", "type": "get_event", "event_id": "chatgpt:me:a-0", "acceptable_event_ids": ["chatgpt:me:a-0"]}]}))
    assert evaluation.preconditions(lake.messages(), suite) == []
    out = evaluation.run_suite(suite, lambda q, **kw: retrieval.search_history(lake, q, **kw), lambda e: retrieval.get_event(lake, e))
    assert (out["passed"], out["recall"], out["refusals"]) == (True, 1.0, 1.0)
    for bad in ({"name": "x"}, {"schema_version": "1", "name": "x", "cases": [{"id": "1", "type": "search"}]}):
        with pytest.raises(ValueError):
            evaluation.load_suite(json.dumps(bad))
    v = [float(x) for x in range(21)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for q in (0.0, 0.5, 0.95, 0.99, 1.0):
        assert evaluation.percentile(df, "v", q).first().value == evaluation.percentile_of(v, q)
    assert evaluation.latency(v)["max"] == 20
    corpus = evaluation.synthetic(spark, 20, 10)
    assert corpus.count() == 200
    rows = corpus.filter("conversation = 'bench-00003'").orderBy("position").collect()
    t, secs = 1754035200 + 600 * 3, []
    for mid in range(10):
        t += 60 + mid % 7
        secs.append(t)
    assert [int(r.created_at.timestamp()) - int(rows[0].created_at.timestamp()) for r in rows] == [s - secs[0] for s in secs]
    items = spark.createDataFrame([(i, float(i), 40) for i in range(10)], "id long, updated double, bytes long")
    assert [r.id for r in evaluation.to_crawl(items, 4.0, 3).collect()] == [5, 6, 7]
    assert evaluation.next_waterline(items, 3.0) == 9.0
    assert evaluation.to_fetch(items, items.filter("id < 9")).count() == 1
    assert [r.id for r in evaluation.backfill(items, items.filter("id = 3"), 5.0, 2).collect()] == [4, 2]
    assert max(r["sum(bytes)"] for r in evaluation.batches(items, 100).groupBy("batch").sum("bytes").collect()) <= 120
    assert [evaluation.retry_after(n) for n in (1, 2, 9)] == [60.0, 120.0, 3600.0]
    curve = spark.createDataFrame([(1, float(i), 100.0 + i) for i in range(11)], "worker int, at double, rss double")
    assert evaluation.growth(curve, 5.0).first().growth == pytest.approx(110 / 105)
    assert evaluation.drift(curve.withColumnRenamed("rss", "seconds")).first().drift == pytest.approx(1.1)


def test_extensions(spark, tmp_path):
    for path, text in (("p/one/plugin.json", '{"name": "One", "version": "1", "description": "first"}'), ("p/two/plugin.json", "{"), ("p/node_modules/x/plugin.json", "{}"), ("p/three/SKILL.md", "---\nname: Three\ndescription: does it\n---\n")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = extensions.manifests(spark, str(tmp_path), ["plugin.json"], "plugin").unionByName(extensions.manifests(spark, str(tmp_path), ["SKILL.md"], "skill"))
    rows = extensions.with_status(found, spark.createDataFrame([("One", True), ("two", False)], "name string, enabled boolean"))
    every = extensions.union([rows, rows])
    assert [(r.kind, r.name, r.status) for r in every.collect()] == [("plugin", "One", "active"), ("plugin", "two", "disabled"), ("skill", "Three", "cached")]
    assert [r.name for r in extensions.matching(every, "FIRST plugin").collect()] == ["One"]
    assert extensions.counts(every).count() == 3
    wanted = spark.createDataFrame([("p", "One", "2"), ("p", "Four", None)], "profile string, name string, version string")
    assert {r.name: r.status for r in extensions.of_profiles(wanted, found).collect()} == {"One": "other_version", "Four": "missing"}
    assert extensions.unlisted(found, wanted).count() == 2


def test_paths_of_long_branched_and_broken_conversations(spark):
    edges = [("long", i, i - 1 if i else None) for i in range(500)] + [("tree", 0, None), ("tree", 1, 0), ("tree", 2, 0), ("tree", 3, 2), ("ring", 0, 1), ("ring", 1, 0), ("lost", 1, 9)]
    leaves = [("long", 499), ("tree", 3), ("ring", 1), ("lost", 1), ("none", 0)]
    got = A.selected_path(spark.createDataFrame(edges, "conversation string, node long, parent long"), spark.createDataFrame(leaves, "conversation string, node long")).collect()
    assert sorted((r.node, r.depth) for r in got if r.conversation == "tree") == [(0, 0), (2, 1), (3, 2)]
    assert sorted((r.node, r.depth) for r in got if r.conversation == "long") == [(i, i) for i in range(500)]
    assert {r.conversation for r in got} == {"long", "tree"}


def test_inbox_publishes_once(spark, tmp_path):
    def put(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"k": k, "v": v}) for k, v in rows))

    run = lambda: inbox.follow(spark, str(tmp_path / "in"), "k long, v string", str(tmp_path / "cp"), inbox.publish_new(str(tmp_path / "out"), ["k"])).awaitTermination()
    put("1.json", [(1, "a"), (2, "b"), (2, "b")])
    run()
    put("2.json", [(2, "c"), (3, "d")])
    run()
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_normal_form_maps_back():
    made, offsets = X.normal_map("ﬁne Straße")
    assert made == "fine strasse"
    assert offsets[made.index("strasse")] == 4
    assert retrieval.plan_term("求职") == ["求职"]
    assert retrieval.plan_term("灯") == retrieval.plan_term("tea") == []


def test_times(spark):
    from chatlake.functions import times

    iso = ["2025-03-01T08:00:00.75Z", "2025-03-01T08:00+02:00", "2025-03-01T08:00:00", "2025-03", "2025-13-01T00:00:00Z", "junk", None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(iso)], "i int, v string").orderBy("i").select(times.from_iso(F.col("v"))).collect()]
    assert [(g.instant, g.precision, g.zone) for g in got[:6]] == [
        (datetime(2025, 3, 1, 8), "second", "utc"), (datetime(2025, 3, 1, 6), "minute", "offset"), (None, "second", "naive"), (None, "month", "naive"), (None, "second", "unknown"), (None, "unknown", "unknown"),
    ]
    unix = [r[0] for r in spark.createDataFrame([("1.5",), ("x",)], "v string").select(times.from_unix_seconds(F.col("v"))).collect()]
    assert [(u.instant, u.original, u.zone) for u in unix] == [(datetime(1970, 1, 1, 0, 0, 1, 500_000), "1.5", "utc"), (None, "x", "unknown")]
    assert spark.range(1).select(times.formatted(F.lit(T0))).first()[0] == "2025-03-01T09:00:00.000000Z"


def test_index_states():
    wanted = {"model": "m", "chunk": 600, "overlap": 100}
    meta = wanted | {"dimension": 4, "packing": "none", "built_at": "now"}
    assert semantic.index_state(None, wanted) == "index_not_built"
    assert semantic.index_state(meta | {"built_at": None}, wanted) == "index_building"
    assert semantic.index_state(meta, wanted | {"packing": "int8"}) == "index_version_mismatch"
    assert semantic.index_state(meta, wanted, 8) == "provider_dimension_mismatch"
    assert semantic.index_state(meta, wanted, 4, 0) == "index_empty"
    assert semantic.index_state(meta, wanted, 4, 1) is None
    assert [semantic.next_action(*x) for x in ((None, wanted, 0, 0), (meta, wanted | {"model": "n"}, 0, 0), (meta, wanted, 1, 0), (meta, wanted | {"packing": "int8"}, 0, 0), (meta, wanted, 0, 0))] == ["full", "full", "reindex", "convert", "skip"]


def test_tools(spark, lake, tmp_path):
    from chatlake import tools

    (tmp_path / "n.md").write_text("# Note\ntomatoes in a note\n")
    a = tools.Archive(lake, note_source.notes(spark, str(tmp_path)))
    got = tools.call(a, "search_brain", {"query": "tomatoes", "limit": 3})["results"]
    assert [r["source"] for r in got] == ["vault", "history", "history"]
    assert tools.call(a, "search_history", {"query": "tomatoes", "order": "no such", "limit": 1})["results"][0]["event_id"] == "chatgpt:me:a-0"
    assert tools.call(a, "search_history", {"query": "tomatoes", "date_from": "2025-03-03", "date_to": "2025-03-03"})["total"] == 1
    assert tools.call(a, "get_vault_note", {"path": "n.md"})["lines"][0] == "# Note"
    assert tools.call(a, "timeline", {})["results"]
    for name, args, code in (("nothing", {}, "UNKNOWN_TOOL"), ("search_history", {"query": ""}, "INVALID_PARAMS"), ("search_history", {"query": "x", "limit": 0}, "INVALID_PARAMS"), ("get_event", {"event_id": "x"}, "NOT_FOUND"), ("search_history", {"query": "x", "date_from": "soon"}, "INVALID_PARAMS")):
        with pytest.raises(tools.ToolError) as e:
            tools.call(a, name, args)
        assert e.value.code == code
    with pytest.raises(tools.ToolError):
        tools.call(a, "recall", {"query": "x"}, {"tools": ["search_history"]})
    with pytest.raises(ValueError, match="profile"):
        tools.call(a, "recall", {}, {"allow_everything": True})
