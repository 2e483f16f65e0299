"""Commits of several writers, withdrawn sources, summaries of policy, the index on disk, old formats and backups."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatlake.functions.text import index_tokens
from chatlake.operators import ids, policy, postings, retrieval, store
from chatlake.operators.commits import Conflict, Log

T0 = datetime(2025, 3, 1, 9)
NODES = "conversation string, title string, current_node string, node string, parent string, child_order long, event_id string, speaker string, created_at timestamp, updated_at timestamp, text string"


def talk(conv, texts, namespace="me", at=T0, updated=None):
    return [(conv, f"title {conv}", f"n{len(texts) - 1}", f"n{i}", f"n{i - 1}" if i else None, 0, f"chatgpt:{namespace}:{conv}-{i}", "owner", at + timedelta(minutes=i), updated, t) for i, t in enumerate(texts)]


@pytest.fixture
def lake(spark, tmp_path):
    return store.Lake(spark, str(tmp_path / "lake"))


def put(spark, lake, rows, sha, namespace="me", **more):
    return store.publish(lake, spark.createDataFrame(rows, NODES), "chatgpt", namespace, sha, T0, **more)


def seen(lake):
    return sorted((r.event_id.split(":")[2], r.text) for r in lake.messages().select("event_id", "text").collect())


def test_two_writers(spark, lake, monkeypatch):
    """The second writer commits while the first one builds: the first builds anew, and nothing is lost or doubled."""
    put(spark, lake, talk("a", ["one", "two"]), "s0")
    plain, turns = store._published, []

    def meanwhile(base, *args):
        out = plain(base, *args)
        if not turns:
            turns.append(base.head())
            other = store.Lake(spark, lake.root)
            put(spark, other, talk("a", ["one", "two", "three"]) + talk("b", ["four"]), "s1")
            store.withdraw_events(other, spark.createDataFrame([("chatgpt:me:a-1", "x")], "event_id string, reason string"), T0)
        return out

    monkeypatch.setattr(store, "_published", meanwhile)
    put(spark, lake, talk("a", ["one", "two changed", "three"], updated=T0) + talk("c", ["five"]), "s2")
    jobs = lake.jobs()
    assert [j["seq"] for j in jobs] == list(range(1, len(jobs) + 1))
    assert [j["kind"] for j in jobs] == ["import", "import", "withdraw", "import"]
    r = lake.table("revisions")
    assert r.count() == r.select("revision_id").distinct().count() == r.select("doc").distinct().count()
    assert sorted(x.doc for x in r.collect()) == list(range(r.count()))
    # a-1 was withdrawn between the two: the version that came after inherits that
    assert {e for e, _ in seen(lake)} == {"a-0", "a-2", "b-0", "c-0"}
    assert set(store.restore_check(lake).values()) == {0}
    folders = {s.getPath().getName() for s in lake.listed("data")}
    assert folders == {j["attempt"] for j in jobs if j["tables"]}  # the first attempt and all that was staged are gone


def test_same_archive_by_two_writers(spark, lake, monkeypatch):
    plain, once = store._published, []

    def meanwhile(base, *args):
        if not once:
            once.append(1)
            put(spark, store.Lake(spark, lake.root), talk("a", ["one"]), "same")
        return plain(base, *args)

    monkeypatch.setattr(store, "_published", meanwhile)
    assert put(spark, lake, talk("a", ["one"]), "same")["kind"] == "duplicate"
    assert lake.table("occurrences").count() == 1


def test_number_is_taken_once(spark, lake):
    log = Log(spark, lake.root)
    log.commit({"seq": 1, "kind": "x", "status": "complete"})
    with pytest.raises(Conflict):
        log.commit({"seq": 1, "kind": "y", "status": "complete"})
    assert [j["kind"] for j in log.jobs()] == ["x"]
    assert not [s for s in log.listed("") if s.getPath().getName().startswith(".0")]


def test_log_is_summed_up(spark, lake, monkeypatch):
    monkeypatch.setattr("chatlake.operators.commits.SUMMED", 3)
    for i in range(1, 8):
        lake.commit({"seq": i, "kind": "x", "status": "complete"})
    assert sorted(s.getPath().getName() for s in lake.listed("jobs") if "upto" in s.getPath().getName() and s.getPath().getName()[0] != ".") == ["upto-000000003.json", "upto-000000006.json"]
    for i in range(1, 7):  # a new reader opens the last sum and what comes after
        lake.delete(f"jobs/{i:09d}.json")
    assert [j["seq"] for j in store.Lake(spark, lake.root).jobs()] == list(range(1, 8))


def test_failed_attempts_and_orphans(spark, lake):
    put(spark, lake, talk("a", ["one"]), "s0")
    bad = spark.createDataFrame(talk("b", ["x"]), NODES).withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.publish(lake, bad, "chatgpt", "me", "s1", T0)
    assert [j["status"] for j in lake.jobs()] == ["complete", "failed"]
    lake.staged(spark.range(3))  # of a writer that died
    assert list(lake.orphans(datetime(2000, 1, 1))) == []
    assert len(list(lake.orphans(datetime(2100, 1, 1)))) >= 1
    assert seen(lake) == [("a-0", "one")]


def test_withdrawn_source_stays_withdrawn(spark, lake):
    source = put(spark, lake, talk("a", ["one"]), "s0")["source_id"]
    put(spark, lake, talk("z", ["other"], "you"), "s0", "you")
    store.withdraw_source(lake, source, T0)
    assert store.withdraw_source(lake, source, T0) is None  # once is enough
    put(spark, lake, talk("a", ["one", "two"]) + talk("b", ["three"]), "s1")
    assert seen(lake) == [("z-0", "other")]
    assert {r.reason for r in lake.policy().filter("not available").collect()} == {"source", "inherited"}
    with pytest.raises(LookupError):
        store.withdraw_source(lake, "nobody", T0)
    with pytest.raises(ValueError, match="withdrawn"):
        store.label(lake, T0, ["public"], [], source=source)


def test_summary_of_policy(spark, lake, monkeypatch):
    put(spark, lake, talk("a", ["one", "two", "three"]), "s0")
    gone = lambda e: spark.createDataFrame([(f"chatgpt:me:{e}", "asked")], "event_id string, reason string")
    store.withdraw_events(lake, gone("a-0"), T0)
    store.compact(lake, T0)
    before = lake.policy().select(*policy_columns).collect()
    assert "Aggregate" not in lake.policy()._jdf.queryExecution().optimizedPlan().toString()  # the summary alone
    store.withdraw_events(lake, gone("a-1"), T0)
    plan = lake.policy()._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join LeftAnti" in plan
    assert len(before) == 3 and seen(lake) == [("a-2", "three")]
    from chatlake.operators.archive import current_policy

    key = lambda df: sorted(map(str, df.select(*policy_columns).collect()))
    assert key(lake.policy()) == key(current_policy(lake.table("policy")))
    monkeypatch.setattr(store, "COMPACT", 1)
    put(spark, lake, talk("b", ["four"]), "s1")
    assert lake.jobs()[-1]["kind"] == "compact"
    assert key(lake.policy()) == key(current_policy(lake.table("policy")))


policy_columns = ["revision_id", "available", "scopes", "sensitivity", "classification", "reason"]


def lists(rows):
    return sorted((r.token, r.block, r.n, tuple(r.docs)) for r in rows.select("token", "block", "n", "docs").collect())


def test_index_merged_and_rebuilt(spark, lake, monkeypatch):
    """Segments that were merged hold the same rows as an index made anew, and both what the texts say."""
    monkeypatch.setattr(postings, "BLOCK_BITS", 3)
    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "PER_BUCKET", 2)
    words = ["tea", "boat", "灯塔求职", "sun", "red red"]
    for i in range(5):
        put(spark, lake, talk(f"c{i}", [f"{words[j % 5]} {words[(i + j) % 5]} w{i}" for j in range(7)]), f"s{i}")
    assert [j["kind"] for j in lake.jobs()].count("merge") == 1
    assert len(lake.parts("postings")) == 2  # four were merged, one came after
    want = {}
    for r in lake.table("revisions").select("doc", index_tokens(F.col("search_text")).alias("t")).collect():
        for t in r.t:
            want.setdefault((t, r.doc >> 3), []).append(r.doc & 7)
    held = {}
    for t, block, n, docs in lists(lake.table("postings")):
        assert n == len(docs) and list(docs) == sorted(docs)
        held.setdefault((t, block), []).extend(docs)
    assert {k: sorted(v) for k, v in held.items()} == {k: sorted(v) for k, v in want.items()}
    texts = {r.doc: r.search_text for r in lake.table("revisions").collect()}
    for tokens in (["tea", "sun"], ["灯塔", "求职", "boat"], ["w3"], ["nothing"], ["red", "w1", "tea"]):
        found = {r.doc for r in postings.candidates(lake.snapshot(), tokens).collect()}
        assert found == {d for d, t in texts.items() if all(x in t for x in tokens)}
    merged = lists(postings.merged(lake.table("postings"), 1))
    postings.rebuild(lake, "revisions", T0)
    assert len(lake.parts("postings")) == 1
    assert lists(lake.table("postings")) == merged


def test_index_opens_only_files_of_its_tokens(spark, lake, monkeypatch):
    monkeypatch.setattr(postings, "PER_BUCKET", 1)
    put(spark, lake, talk("a", [f"word{i} shared" for i in range(40)]), "s0")
    (path, buckets, there), = postings.segments(lake)
    assert buckets >= 32 and len(there) > 10
    rows = postings.lookup(spark, postings.segments(lake), ["word7"])
    files = rows.inputFiles()
    assert len(files) == 1 and [r.n for r in rows.collect()] == [1]
    assert len(postings.lookup(spark, postings.segments(lake), ["word7", "word8"]).inputFiles()) <= 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "word7" in plan
    import pyarrow.parquet as pq

    column = pq.ParquetFile(files[0].replace("file://", "")).metadata.row_group(0).column(3)
    assert "DELTA_BINARY_PACKED" in column.encodings


def test_search_uses_the_index(spark, lake):
    put(spark, lake, talk("a", ["我要求职", "求职进展", "nothing", "职业", "求 职"]), "s0")
    found = retrieval.search_history(lake, "求职")
    assert [r["event_id"][-3:] for r in found["results"]] == ["a-0", "a-1"]
    rows = retrieval.hits(lake.snapshot(), lake.messages(), "求职")
    assert "bucket=" in " ".join(rows.inputFiles())


def test_hybrid_pages_lose_nothing(spark, lake):
    rows = [(c, t, cur, n, p, o, e, s, T0, u, x) for c, t, cur, n, p, o, e, s, _, u, x in talk("a", ["tea"] * 3 + ["tea tea", "tea sun", "other"])]
    put(spark, lake, rows, "s0")

    class Provider:
        def embed(self, texts):
            return [[1.0, 0.0]]

    vectors = lake.messages().select("revision_id", F.lit(0).alias("chunk"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.array(F.lit(0.8), F.lit(0.6)).alias("embedding"))
    for order in retrieval.ORDERS:
        ask = lambda limit, cursor=None: retrieval.search_history(lake, "tea", order=order, limit=limit, cursor=cursor, vectors=vectors, provider=Provider())  # noqa: E731, B023
        whole = ask(50)
        paged, cursor = [], None
        while True:
            page = ask(2, cursor)
            paged += [r["event_id"] for r in page["results"]]
            assert page["total"] == whole["total"] == 6
            if not (cursor := page["next_cursor"]):
                break
        assert sorted(paged) == sorted(r["event_id"] for r in whole["results"]) and len(set(paged)) == 6


def test_all_pages_at_once(spark, lake, monkeypatch):
    """The same hits in the same order as page by page, whatever the number of pages, by one search."""
    put(spark, lake, talk("a", ["tea"] * 3 + ["tea tea", "tea sun", "other"]), "s0")
    put(spark, lake, talk("b", ["tea boat", "tea", "sun"]), "s1")

    class Provider:
        def embed(self, texts):
            return [[1.0, 0.0]]

    vectors = lake.messages().select("revision_id", F.lit(0).alias("chunk"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.array(F.lit(0.8), F.lit(0.6)).alias("embedding"))
    searches, plain = [], retrieval.hits
    monkeypatch.setattr(retrieval, "hits", lambda *a, **b: (searches.append(1), plain(*a, **b))[1])
    for order in retrieval.ORDERS:
        for more in ({}, {"vectors": vectors, "provider": Provider()}):
            paged, cursor = [], None
            while True:
                page = retrieval.search_history(lake, "tea", order=order, limit=4, cursor=cursor, **more)
                paged.append([(r["event_id"], r["revision_id"], r["kind"]) for r in page["results"]])
                if not (cursor := page["next_cursor"]):
                    break
            searches.clear()
            rows = retrieval.all_pages(lake, "tea", order=order, limit=4, **more).orderBy("place").collect()
            assert [(r.place, r.page) for r in rows] == [(i, i // 4) for i in range(len(rows))] and len(searches) == 1
            assert [(r.event_id, r.revision_id, r.kind) for r in rows] == sum(paged, [])


def test_several_versions_of_an_event_on_pages(spark, lake):
    put(spark, lake, talk("a", ["tea one"]), "s0")
    put(spark, lake, talk("a", ["tea two"], updated=T0), "s1")
    first = retrieval.search_history(lake, "tea", limit=1)
    second = retrieval.search_history(lake, "tea", limit=1, cursor=first["next_cursor"])
    assert len({first["results"][0]["revision_id"], second["results"][0]["revision_id"]}) == 2 and second["next_cursor"] is None


def test_filters_and_undated(spark, lake):
    put(spark, lake, talk("a", ["tea a"]) + talk("b", ["tea b"], at=T0 + timedelta(days=3)), "s0")
    other = put(spark, lake, talk("c", ["tea c"], "you"), "s0", "you")["source_id"]
    undated = [(c, t, cur, n, p, o, e, s, None, u, x) for c, t, cur, n, p, o, e, s, _, u, x in talk("d", ["tea d"])]
    put(spark, lake, undated, "s1")
    ask = lambda **f: [r["event_id"].split(":")[2] for r in retrieval.search_history(lake, "tea", **f)["results"]]
    assert ask(namespace="you") == ask(source=other) == ask(conversation="c") == ["c-0"]
    inside = retrieval.search_history(lake, "tea", date_from=F.lit(T0 + timedelta(days=1)))
    assert ([r["event_id"][-3:] for r in inside["results"]], inside["total"], inside["undated"]) == (["b-0"], 1, 1)


def test_coverage_is_kept_until_something_changes(spark, lake, monkeypatch):
    put(spark, lake, talk("a", ["tea"]), "s0")
    calls, plain = [], retrieval.coverage
    monkeypatch.setattr(retrieval, "coverage", lambda df: calls.append(1) or plain(df))
    assert retrieval.search_history(lake, "tea")["coverage"]["last"] == T0
    retrieval.search_history(lake, "tea", limit=1)
    assert len(calls) == 1
    put(spark, lake, talk("b", ["tea"], at=T0 + timedelta(days=9)), "s1")
    assert retrieval.search_history(lake, "tea")["coverage"]["last"] == T0 + timedelta(days=9)
    store.withdraw_events(lake, spark.createDataFrame([("chatgpt:me:b-0", "x")], "event_id string, reason string"), T0)
    assert retrieval.search_history(lake, "tea")["coverage"]["last"] == T0
    assert len(calls) == 3


def test_tools_try_again_when_policy_changes(spark, lake, monkeypatch):
    from chatlake import tools

    put(spark, lake, talk("a", ["tea one", "tea two"]), "s0")
    plain, once = tools.TOOLS["search_history"], []

    def meanwhile(a, args, profile):
        out = plain(a, args, profile)
        if not once:
            once.append(1)
            store.withdraw_events(lake, spark.createDataFrame([("chatgpt:me:a-0", "x")], "event_id string, reason string"), T0)
        return out

    monkeypatch.setitem(tools.TOOLS, "search_history", meanwhile)
    assert [r["event_id"][-3:] for r in tools.call(tools.Archive(lake), "search_history", {"query": "tea"})["results"]] == ["a-1"]


def test_messages_without_an_id_and_attachments(spark, lake):
    rows = spark.createDataFrame(talk("a", ["same", "same"]), NODES).withColumns({
        "message_id": F.when(F.col("node") == "n0", F.lit("own")), "content_type": F.lit("multimodal_text"), "attachments": F.lit('["x.png"]'),
    })
    store.publish(lake, rows, "chatgpt", "me", "s0", T0)
    got = {r.node: r for r in lake.table("revisions").collect()}
    assert got["n0"].event_id == "chatgpt:me:own"
    assert got["n1"].event_id.startswith("chatgpt:me:fb-")
    assert (got["n1"].content_type, got["n1"].attachments) == ("multimodal_text", '["x.png"]')
    plain = ids.revision_hash(*[F.lit(x) for x in ("text", "same", "owner")], F.lit(T0), F.lit(None), F.lit(None).cast("string"))
    assert spark.range(1).select(ids.revision_id(F.lit("chatgpt:me:own"), plain)).first()[0] != got["n0"].revision_id


def test_older_format_is_read(spark, lake):
    """Format 1: a list of tables, each with a folder for the number of the change; there was no index."""
    put(spark, lake, talk("a", ["one"]), "s0")
    job = lake.jobs()[0]
    old = store.Lake(spark, lake.root + "-old")
    for name, e in job["tables"].items():
        if name != "postings":
            spark.read.parquet(f"{lake.root}/{e['path']}").drop("doc", "attachments").write.parquet(f"{old.root}/{name}/job=1")
    content = {k: v for k, v in job.items() if k not in ("format", "attempt", "index_buckets", "indexed", "docs")} | {"tables": [t for t in job["tables"] if t != "postings"]}
    assert old._put("000000001.json", content)
    assert seen(store.Lake(spark, old.root)) == [("a-0", "one")]
    with pytest.raises(ValueError, match="newer"):
        from chatlake.operators.commits import upgraded

        upgraded({"format": 99})


def test_backup_is_an_archive(spark, lake, tmp_path):
    put(spark, lake, talk("a", ["tea one", "tea two"]), "s0")
    put(spark, lake, talk("a", ["tea one changed", "tea two"], updated=T0), "s1")
    gone = put(spark, lake, talk("z", ["tea gone"], "you"), "s0", "you")["source_id"]
    store.withdraw_source(lake, gone, T0)
    store.compact(lake, T0)
    path = store.backup(lake, str(tmp_path / "backups"), T0)["path"]
    copy = store.Lake(spark, path)
    assert store.backup_check(spark, path) and set(store.restore_check(copy).values()) == {0}
    assert seen(copy) == seen(lake) and len(seen(copy)) == 4
    ask = lambda x: [(r["event_id"], r["snippet"], r["occurrences"]) for r in retrieval.search_history(x, "tea")["results"]]
    assert ask(copy) == ask(lake)
    assert put(spark, copy, talk("a", ["tea one", "tea two"]), "s0")["kind"] == "duplicate"
    put(spark, copy, talk("z", ["tea more"], "you"), "s1", "you")
    put(spark, copy, talk("b", ["tea new"]), "s2")
    assert [t for _, t in seen(copy)] == ["tea one", "tea one changed", "tea two", "tea two", "tea new"]
    assert copy.table("revisions").select("doc").distinct().count() == copy.table("revisions").count()
    with pytest.raises(FileExistsError):
        store.backup(lake, str(tmp_path / "backups"), T0)


def test_backup_names_damaged_files(spark, lake, tmp_path):
    put(spark, lake, talk("a", ["tea one", "tea two"]), "s0")
    path = store.backup(lake, str(tmp_path / "backups"), T0)["path"]
    entry = store.Lake(spark, path).parts("occurrences")[0][1]["path"]
    spark.read.parquet(f"{path}/{entry}").limit(1).write.parquet(f"{path}/{entry}-short")
    other = store.Lake(spark, path)
    other.delete(entry)
    assert other.fs().rename(other.path(f"{entry}-short"), other.path(entry))
    assert {r.name for r in store.backup_faults(spark, path).collect()} == {"occurrences"}
    assert not store.backup_check(spark, path)


def test_jobs_hold_what_they_name(spark, lake):
    job = put(spark, lake, talk("a", ["one"]), "s0")
    stream = lake.fs().open(lake.path("jobs/000000001.json"))
    content = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    assert content == job and content["tables"]["revisions"]["rows"] == 1
    assert policy.epoch_of(lake.table("policy")) == lake.epoch() == 1


def test_cleaning_is_applied_after_a_backup(spark, lake, tmp_path, monkeypatch):
    from chatlake.operators import cleaning

    put(spark, lake, talk("codex-1", ["# AGENTS.md instructions\nx", "mine"], "codex") + talk("b", ["# AGENTS.md instructions"], "codex"), "s0", "codex")
    put(spark, lake, talk("c", ["# AGENTS.md instructions"], "me"), "s0")  # of no tool
    assert sorted(r.rule for r in cleaning.planned(lake).collect()) == ["codex_agents_md"] * 2
    monkeypatch.setattr(store, "backup_check", lambda *_: False)
    with pytest.raises(RuntimeError, match="sound"):
        cleaning.apply(lake, str(tmp_path / "first"), T0)
    assert len(seen(lake)) == 4
    monkeypatch.undo()
    done = cleaning.apply(lake, str(tmp_path / "second"), T0)
    assert done["events"] == 2 and len(seen(store.Lake(spark, done["backup"]))) == 4
    assert [e for e, _ in seen(lake)] == ["c-0", "codex-1-1"]
    assert {r.reason for r in lake.policy().filter("not available").collect()} == {"cleaned: codex_agents_md"}
    assert cleaning.apply(lake, str(tmp_path / "third"), T0) == {"events": 0, "backup": None}
