"""Queries over stored archives that are made of the given tables: imports, withdrawals, pages, the index, backups."""

from __future__ import annotations

import string
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.operators import claims, cleaning, closure, facts, ivf, partials, postings, retrieval, store, vectors
from chatlake.operators import semantic as V
from chatlake.plans import queries as Q
from chatlake.sources import archives, exports
from chatlake.operators.scratch import folder, listed

NOW = datetime(2024, 6, 1)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """conversations as the nodes of an export."""
    m = Q.messages(spark, d)
    last = Window.partitionBy("conversation")
    node = lambda c: c.cast("long").cast("string")
    return m.select(
        F.col("conversation").cast("string").alias("conversation"),
        F.lit("t").alias("title"),
        node(F.max("position").over(last)).alias("current_node"),
        node(F.col("position")).alias("node"),
        F.when(F.col("position") > 0, node(F.col("position") - 1)).alias("parent"),
        F.lit(0).cast("long").alias("child_order"),
        "event_id",
        "speaker",
        "created_at",
        F.lit(None).cast("timestamp").alias("updated_at"),
        "text",
    )


def of_remainder(rows: DataFrame, *remainders: int) -> DataFrame:
    return rows.filter((F.col("conversation").cast("long") % 4).isin(*remainders))


def edited(rows: DataFrame) -> DataFrame:
    """The rows as edited at NOW, or a second after they were written where that is later."""
    after = F.col("created_at") + F.expr("INTERVAL 1 SECOND")
    return rows.withColumns({"text": F.concat("text", F.lit(" (edited)")), "updated_at": F.greatest(F.lit(NOW), after)})


def _lake(spark: SparkSession) -> store.Lake:
    return store.Lake(spark, folder(spark))


def imported_twice(spark: SparkSession, d: str) -> store.Lake:
    """All conversations, the same again, and then all with every even one edited."""
    lake, rows = _lake(spark), nodes(spark, d)
    store.publish(lake, rows, "chatgpt", "driver", "first", NOW)
    store.publish(lake, rows, "chatgpt", "driver", "first", NOW)
    even = F.col("conversation").cast("long") % 2 == 0
    changed = edited(rows.filter(even)).unionByName(rows.filter(~even))
    store.publish(lake, changed, "chatgpt", "driver", "second", NOW + timedelta(days=1))
    return lake


def lake_import(spark: SparkSession, d: str) -> DataFrame:
    """Each message's current text, its revisions and occurrences, its place on the path, and its policy."""
    lake = imported_twice(spark, d).snapshot()
    r = lake.table("revisions")
    text = r.select(F.col("revision_id").alias("current_revision_id"), "text", "source_id", "conversation", "node")
    now = lake.current().join(text, "current_revision_id")
    count = r.groupBy("event_id").agg(F.count(F.lit(1)).alias("revisions"))
    seen = lake.table("occurrences").join(r.select("revision_id", "event_id"), "revision_id").groupBy("event_id").agg(F.count(F.lit(1)).alias("occurrences"))
    state = lake.policy().join(r.select("revision_id", "event_id"), "revision_id")
    state = state.groupBy("event_id").agg(F.count_if("available").alias("available"), F.max("classification").alias("classification"))
    paths = lake.paths().select("event_id", "position")
    out = now.join(count, "event_id").join(seen, "event_id").join(state, "event_id").join(paths, "event_id", "left")
    same = F.col("node").cast("long") == F.col("position")
    return out.select("event_id", F.md5("text").alias("text"), "state", "revisions", "occurrences", "available", "classification", "position", same.alias("at_node"))


def lake_index(spark: SparkSession, d: str) -> DataFrame:
    """How many messages hold each word, from the merged segments of four imports that hold a part of the conversations each."""
    lake, rows = _lake(spark), nodes(spark, d)
    for i in range(4):
        store.publish(lake, of_remainder(rows, i), "chatgpt", "driver", f"part {i}", NOW)
    state = lake.snapshot()
    if len(state.parts("postings")) != 1:
        raise ValueError("the segments aren't merged")
    return state.table("postings").groupBy("token").agg(F.sum("n").alias("n"))


def lake_search_by_index(spark: SparkSession, d: str) -> DataFrame:
    """Messages with both words by the index of an archive, intersected block by block, and joined with their texts."""
    lake = imported_twice(spark, d).snapshot()
    found = postings.candidates(lake, ["the", "edited"])
    return lake.messages().join(found, "doc", "left_semi").groupBy("event_id").agg(F.count(F.lit(1)).alias("revisions"))


def policy_source_reimport(spark: SparkSession, d: str) -> DataFrame:
    """What is visible after a source was withdrawn and imported again with more, beside another source."""
    lake, rows = _lake(spark), nodes(spark, d)
    job = store.publish(lake, of_remainder(rows, 0, 1), "chatgpt", "gone", "first", NOW)
    store.publish(lake, of_remainder(rows, 0), "chatgpt", "stays", "first", NOW)
    store.withdraw_source(lake, job["source_id"], NOW)
    store.withdraw_source(lake, job["source_id"], NOW)
    store.publish(lake, of_remainder(rows, 1, 2), "chatgpt", "gone", "second", NOW)
    store.publish(lake, of_remainder(edited(rows), 0), "chatgpt", "stays", "second", NOW)
    return lake.messages().select("event_id", F.md5("text").alias("text"))


def policy_event_reimport(spark: SparkSession, d: str) -> DataFrame:
    """What is visible after events were withdrawn, the log summed up, labels put on what is left, and all imported edited."""
    lake, rows = _lake(spark), nodes(spark, d)
    job = store.publish(lake, rows, "chatgpt", "driver", "first", NOW)
    gone = rows.filter("node = '1'").select("event_id", F.lit("asked for").alias("reason"))
    store.withdraw_events(lake, gone, NOW)
    store.compact(lake, NOW)
    store.label(lake, NOW, ["public"], [], source=job["source_id"])
    store.publish(lake, of_remainder(edited(rows), 3), "chatgpt", "driver", "second", NOW)
    state = lake.policy().select("revision_id", "classification")
    return lake.messages().join(state, "revision_id").select("event_id", F.md5("text").alias("text"), "classification")


def hybrid_pages(spark: SparkSession, d: str) -> DataFrame:
    """All hits of a search, page by page, with vectors and times that many hits share: their places in the order."""
    lake, rows = _lake(spark), nodes(spark, d)
    rows = rows.withColumn("created_at", F.when(F.col("conversation").cast("long") % 3 > 0, F.date_trunc("day", "created_at")))
    store.publish(lake, rows, "chatgpt", "driver", "first", NOW)
    vectors = lake.messages().select("revision_id", F.lit(0).alias("chunk"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.array(F.lit(0.6), F.lit(0.8)).alias("embedding"))
    found = retrieval.all_pages(lake, "the th", order="reverse", limit=7, vectors=vectors, provider=_Same()).filter("kind <> 'semantic'")
    found = found.select("event_id", "place", F.date_format("created_at", "yyyy-MM-dd").alias("day"))
    days = found.groupBy("day").agg(F.min("place").alias("first"))
    nth = lambda c: F.row_number().over(Window.orderBy(c))
    days = days.select(F.col("day").alias("of"), (nth(F.col("day").desc_nulls_last()) == nth(F.col("first"))).alias("in_order"))  # a row a day
    return found.join(days, F.col("day").eqNullSafe(F.col("of"))).select("event_id", "day", "in_order")


class _Same:
    """A provider whose vectors are all the same, so every message is as near as any other."""

    model_id, dimension = "same", 2

    def embed(self, texts):
        return [[0.6, 0.8] for _ in texts]


def lake_restored(spark: SparkSession, d: str) -> DataFrame:
    """A search in the backup of an archive with withdrawn events, after one more import into it."""
    lake, rows = _lake(spark), nodes(spark, d)
    store.publish(lake, of_remainder(rows, 0, 1, 2), "chatgpt", "driver", "first", NOW)
    store.withdraw_events(lake, rows.filter("node = '0'").select("event_id", F.lit("asked for").alias("reason")), NOW)
    path = store.backup(lake, folder(spark), NOW)["path"]
    if not store.backup_check(spark, path):
        raise ValueError("the backup isn't what its manifest says")
    copy = store.Lake(spark, path)
    store.publish(copy, of_remainder(rows, 3), "chatgpt", "driver", "second", NOW)
    found = copy.messages().join(postings.candidates(copy.snapshot(), ["the"]), "doc", "left_semi")
    return found.select("event_id", F.col("search_text").contains("the").alias("holds"))


def ivf_exact(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of each hundredth vector by the inverted lists, with as many probes as there are lists."""
    index, vectors = _index(spark, d)
    found = ivf.search(index, _asked(vectors, 100), 10, len(index.centroids))
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the lists, with probes chosen by other queries, give nine tenths of the ten nearest of each fifth vector."""
    index, vectors = _index(spark, d)
    asked = _asked(vectors, 5)
    found = ivf.search(index, asked, 10, ivf.probes_for(index, 0.95, 10))
    return ivf.recall(found, ivf.exact(vectors, asked, 10)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


def _asked(vectors: DataFrame, nth: int) -> DataFrame:
    return vectors.filter(F.col("vec_id") % nth == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _index(spark: SparkSession, d: str) -> tuple[ivf.Index, DataFrame]:
    vectors = Q.table(spark, d, "embeddings").select("vec_id", "embedding")
    centers = ivf.centroids(vectors, 20)
    path = folder(spark)
    ivf.blocks(ivf.dealt(vectors, centers), "vec_id").sortWithinPartitions("list").write.parquet(path)
    return ivf.Index(spark.read.parquet(path), centers, "vec_id", "embedding"), vectors


def reached_turns(spark: SparkSession, d: str) -> DataFrame:
    """Which turns each conversation's last one leads to, where every turn leads to the one before, and in each fourth
    conversation the first to the last again."""
    c = Q.table(spark, d, "conversations").select("conv_id", "turn")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    name = lambda turn: F.col("conv_id") * 1000 + turn
    before = F.when(F.col("turn") > 0, F.col("turn") - 1).when(F.col("conv_id") % 4 == 2, F.col("last"))
    edges = c.join(last, "conv_id").select(name(F.col("turn")).alias("source"), name(before).alias("target"))
    return closure.reached(edges, last.select(name(F.col("last")).alias("start")))


def archive_read(spark: SparkSession, d: str) -> DataFrame:
    """Messages of exports that were written as four JSON arrays, read again one conversation at a time."""
    m = Q.messages(spark, d).withColumn("at", F.unix_seconds("created_at"))
    author = F.struct(F.when(F.col("speaker") == "owner", "user").otherwise(F.col("speaker")).alias("role"))
    node = lambda p: p.cast("long").cast("string")
    message = F.struct(F.col("event_id").alias("id"), author.alias("author"), F.col("at").alias("create_time"), F.struct(F.array("text").alias("parts")).alias("content"))
    entry = F.struct(node(F.col("position")).alias("key"), F.struct(node(F.col("position")).alias("id"), F.when(F.col("position") > 0, node(F.col("position") - 1)).alias("parent"), message.alias("message")).alias("value"))
    mapping = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    one = m.groupBy("conversation").agg(F.to_json(F.struct(F.first("conversation").cast("string").alias("conversation_id"), mapping.alias("mapping"), node(F.max("position")).alias("current_node"))).alias("value"))
    out = folder(spark)
    one.repartition(4, "conversation").select("value").mapInPandas(_as_array, "value string").write.text(out)
    _renamed(spark, out)
    rows = exports.chat_export(spark, out, "driver", archives.archive_elements(spark, out).select("file", "value"))
    return rows.select("conversation", "message_id", "speaker", F.md5("text").alias("text"), "parent")


def _as_array(parts):
    """Lines that together are a JSON array."""
    mark = "["
    for part in parts:
        part["value"] = [("," if i or mark == "," else "[") + v for i, v in enumerate(part["value"])]
        mark = "," if len(part) else mark
        yield part
    yield pd.DataFrame({"value": ["[]" if mark == "[" else "]"]})


def _renamed(spark: SparkSession, path: str) -> None:
    """Text files named as JSON."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(where):
        if s.getPath().getName().endswith(".txt"):
            fs.rename(s.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}.json"))


def vectors_updated(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each message in a stored index that was made in batches, brought up to date after edits, and purged."""
    index, m = vectors.VectorIndex(spark, folder(spark)), Q.messages(spark, d)
    rows = m.select(F.col("event_id").alias("revision_id"), "text", "conversation")
    vectors.update(index, rows, V.HashEmbedding(64), NOW, batch=200)
    now = rows.filter("conversation % 4 <> 0").withColumn("text", F.when(F.col("conversation") % 4 == 1, F.repeat("text", 3)).otherwise(F.col("text")))
    vectors.update(index, now, V.HashEmbedding(64), NOW, batch=200)
    vectors.purge(index, now.filter("conversation % 4 = 2"), NOW)
    return index.snapshot().alive("vectors").groupBy("revision_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("end").alias("end"))


def lake_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Two conversations a local day, by their last message, with the owner's first line and how many more there are."""
    lake = _lake(spark)
    store.publish(lake, nodes(spark, d), "chatgpt", "driver", "first", NOW)
    t = retrieval.timeline(lake, Q.ZONE, per_day=2)
    day = F.date_format("day", "yyyy-MM-dd").alias("day")
    return t.select(day, "conversation", "n", "n_owner", F.col("rank").cast("long").alias("rank"), F.col("more").cast("long").alias("more"), "line")


def lake_context(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours, on their paths, of the second message of each fifth conversation, one of which is withdrawn."""
    lake, rows = _lake(spark), nodes(spark, d)
    store.publish(lake, rows, "chatgpt", "driver", "first", NOW)
    store.withdraw_events(lake, rows.filter("node = '2' and conversation % 2 = 0").select("event_id", F.lit("asked for").alias("reason")), NOW)
    asked = rows.filter("node = '1' and conversation % 5 = 0").select("event_id")
    return retrieval.context(lake.snapshot(), asked, 1).select("event_id", "position")


def lake_status(spark: SparkSession, d: str) -> DataFrame:
    """Rows by table, and changes by kind and status."""
    lake = imported_twice(spark, d).snapshot()
    jobs = spark.createDataFrame([(f"{j['kind']} {j['status']}",) for j in lake.jobs()], "table string").groupBy("table").agg(F.count(F.lit(1)).alias("rows"))
    return store.counts(lake).filter("table <> 'postings'").unionByName(jobs)


def lake_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Messages and times by source from partial aggregates, for two profiles, after changes of policy between four imports."""
    lake, rows = _lake(spark), nodes(spark, d)
    jobs = {"driver": store.publish(lake, of_remainder(rows, 0, 1), "chatgpt", "driver", "first", NOW)}
    jobs["other"] = store.publish(lake, of_remainder(rows, 2), "chatgpt", "other", "first", NOW)
    store.withdraw_events(lake, of_remainder(rows, 0, 1).filter("node = '1'").select("event_id", F.lit("asked for").alias("reason")), NOW)
    store.label(lake, NOW, ["public"], [], source=jobs["driver"]["source_id"])
    store.compact(lake, NOW)
    store.publish(lake, of_remainder(edited(rows), 1, 3), "chatgpt", "driver", "second", NOW)
    gone = store.publish(lake, of_remainder(rows, 0), "chatgpt", "gone", "first", NOW)
    store.withdraw_source(lake, gone["source_id"], NOW)
    state = lake.snapshot()
    if not partials.complete(state):
        raise ValueError("a change has written no partials")
    names = listed(spark, "source_id string, source string", [(j["source_id"], n) for n, j in jobs.items()])
    every = partials.sources(state).withColumn("seen", F.lit("all"))
    public = partials.sources(state, ["public"], classified=True).withColumn("seen", F.lit("public"))
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    found = every.unionByName(public).join(F.broadcast(names), "source_id", "left")
    return found.select("seen", "source", "messages", time("first"), time("last"))


def claims_checked(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with claims that quote the owner's messages, by conversation: five kinds of them."""
    m = Q.messages(spark, d).withColumn("kind", F.col("conversation") % 5)
    role = F.when(F.col("position") == 0, "context").otherwise("support").alias("role")
    name = F.col("conversation").cast("string").alias("conversation")
    segmented = m.select(name, F.lit(0).cast("long").alias("segment"), F.col("position").alias("place"), F.col("event_id").alias("revision_id"), "speaker", "created_at", "text", role)
    quote = F.when(F.col("kind") == 2, "not a word of it").otherwise(F.substring("text", 1, 30))
    source = F.when(F.col("kind") == 3, "nobody").otherwise(F.col("event_id"))
    claim = F.struct(
        F.concat(F.lit("says "), F.substring("text", 1, 20)).alias("content"),
        F.when(F.col("kind") == 1, "mood").otherwise("goal").alias("memory_type"),
        F.lit("self_report").alias("assertion_kind"),
        F.array(F.struct(source.alias("revision_id"), quote.alias("quote"))).alias("evidence"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", claim.alias("claim")))), lambda x: x["claim"])
    answers = m.groupBy(name).agg(F.to_json(F.struct(listed.alias("claims"))).alias("answer"))
    answers = answers.select("conversation", F.lit(0).cast("long").alias("segment"), "answer")
    found = facts.validated(facts.proposals(spark, answers), segmented)
    return found.select("conversation", F.col("nth").cast("long").alias("nth"), F.coalesce("reason", F.lit("stands")).alias("reason"))


def louder(text: str) -> Column:
    """a to z as capitals. upper() would make SS of ß and other pairs, of which lower() gives other letters than it was given."""
    return F.translate(text, string.ascii_lowercase, string.ascii_uppercase)


def claims_stored(spark: SparkSession, d: str) -> DataFrame:
    """Claims of three runs over the benchmark's texts, the second of which is the first again, by how they stand."""
    held = claims.ClaimStore(spark, folder(spark))
    b = Q.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("revision_id"), F.substring("text", 1, 200).alias("text"))
    proof = F.array(F.struct("revision_id", F.lit(0).alias("start"), F.lit(9).alias("end"), F.lit("").alias("quote")))
    rows = b.select(F.lit("c").alias("conversation"), F.lit(0).cast("long").alias("segment"), F.lit(0).alias("nth"), F.col("text").alias("content"), F.lit("goal").alias("memory_type"), F.lit("self_report").alias("assertion_kind"), F.lit(NOW).alias("asserted_at"), proof.alias("evidence"), F.lit(None).cast("string").alias("reason"))
    even = F.col("evidence")[0]["revision_id"].cast("long") % 2 == 0
    claims.record(held, "one", rows.filter(even), b, NOW)
    claims.record(held, "one", rows, b, NOW)
    claims.record(held, "two", rows.withColumn("content", louder("content")), b, NOW + timedelta(days=1))
    proofs = held.table("evidence").groupBy("claim_id").agg(F.count(F.lit(1)).alias("evidence"))
    return held.state().join(proofs, "claim_id").select(F.md5(F.lower("content")).alias("content"), "run", "status", "evidence")


def lake_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """What of three tools' conversations, a third of which begin with a mark of theirs, is left once the rules were applied."""
    lake, names = _lake(spark), ("codex", "claude", "dsh")
    marked = Q._marked(spark, d).select("event_id", F.col("text").alias("marked"))
    rows = nodes(spark, d).join(marked, "event_id").withColumn("text", F.col("marked")).drop("marked")
    for i, name in enumerate(names):
        store.publish(lake, rows.filter(F.col("conversation").cast("long") % 3 == i), "chatgpt", name, "first", NOW)
    cleaning.apply(lake, folder(spark), NOW)
    if cleaning.apply(lake, folder(spark), NOW)["events"]:
        raise ValueError("something was left")
    return lake.messages().select("event_id")


NAMES = """lake_coverage lake_cleaned lake_timeline lake_context lake_status claims_checked claims_stored reached_turns archive_read vectors_updated lake_import lake_index lake_search_by_index policy_source_reimport policy_event_reimport hybrid_pages lake_restored ivf_exact
ivf_recall""".split()
QUERIES = {name: globals()[name] for name in NAMES}
_M = f"WITH {Q.MESSAGES}"
_EVENT = "'chatgpt:{0}:driver:' || conversation || '-' || position"
_WORDS = "list_distinct(regexp_extract_all(s, '[\\p{L}\\p{N}]+'))"
_FAR = "list_sum([(v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2 FOR i IN range(1, 65)])"
SQL = {
    "lake_coverage": f"""{_M}, v AS (SELECT 'driver' AS source, true AS public, created_at FROM m WHERE conversation % 4 IN (0, 1) AND position <> 1
 UNION ALL SELECT 'driver', false, created_at FROM m WHERE conversation % 4 = 3 OR (conversation % 4 = 1 AND position <> 1)
 UNION ALL SELECT 'other', false, created_at FROM m WHERE conversation % 4 = 2)
 SELECT seen, source, count(*) AS messages, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS "first", strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS "last"
 FROM v, (VALUES ('all'), ('public')) AS p(seen) WHERE seen = 'all' OR public GROUP BY seen, source""",
    "lake_cleaned": """WITH m AS (SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN CASE WHEN conv_id % 18 = 1 THEN 'command_name_block' WHEN conv_id % 9 = 0 THEN 'codex_agents_md' WHEN conv_id % 9 = 2 THEN 'dsh_runtime_context' END END AS own,
  bool_or(turn = 0 AND conv_id % 9 = 3 AND role = 'user') OVER (PARTITION BY conv_id) AS session FROM conversations)
 SELECT 'chatgpt:' || CASE conv_id % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' ELSE 'dsh' END || ':' || conv_id || '-' || turn AS event_id
 FROM m WHERE NOT (role = 'user' AND (session OR own IS NOT NULL))""",
    "lake_timeline": f"""{_M}, t AS (SELECT CAST(created_at + INTERVAL 8 HOUR AS DATE) AS day, CAST(conversation AS VARCHAR) AS conversation, count(*) AS n,
  count(*) FILTER (WHERE speaker = 'owner') AS n_owner, max(created_at) AS last_at, arg_min(text, (created_at, event_id)) FILTER (WHERE speaker = 'owner') AS line FROM m GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY last_at DESC, conversation) AS rank, count(*) OVER (PARTITION BY day) AS k FROM t)
 SELECT strftime(day, '%Y-%m-%d') AS day, conversation, n, n_owner, rank, greatest(k - 2, 0) AS more, substr(split_part(substr(line, 1, 400), chr(10), 1), 1, 80) AS line FROM r WHERE rank <= 2""",
    "lake_context": f"""{_M}, a AS (SELECT conversation FROM m WHERE position = 1 AND conversation % 5 = 0)
 SELECT event_id, position FROM m JOIN a USING (conversation) WHERE position <= 2 AND NOT (position = 2 AND conversation % 2 = 0)""",
    "lake_status": """WITH n AS (SELECT count(*) AS n, count(DISTINCT conv_id) AS c, count(*) FILTER (WHERE conv_id % 2 = 0) AS e FROM conversations)
 SELECT * FROM (SELECT 'conversations' AS "table", 2 * c AS rows FROM n UNION ALL SELECT 'nodes', 2 * n FROM n UNION ALL SELECT 'revisions', n + e FROM n UNION ALL SELECT 'occurrences', 2 * n FROM n
 UNION ALL SELECT 'policy', n + e FROM n UNION ALL SELECT 'sources', 0 FROM n UNION ALL SELECT 'import complete', 2 FROM n UNION ALL SELECT 'duplicate complete', 1 FROM n)""",
    "claims_checked": f"""{_M} SELECT CAST(conversation AS VARCHAR) AS conversation, row_number() OVER (PARTITION BY conversation ORDER BY position) - 1 AS nth,
 CASE WHEN trim(text) = '' THEN 'no_evidence' WHEN conversation % 5 = 1 THEN 'invalid_memory_type' WHEN conversation % 5 = 3 THEN 'no_evidence' WHEN speaker <> 'owner' THEN 'assistant_only_evidence'
  WHEN position = 0 THEN 'no_evidence' WHEN conversation % 5 = 2 THEN 'span_mismatch' ELSE 'stands' END AS reason FROM m""",
    "claims_stored": """SELECT md5(lower(substr(text, 1, 200))) AS content, CASE WHEN item_id % 2 = 0 THEN 'one' ELSE 'two' END AS run, 'pending' AS status, 1::BIGINT AS evidence FROM benchmark""",
    "reached_turns": """WITH RECURSIVE l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
 e AS (SELECT conv_id * 1000 + turn AS source, conv_id * 1000 + CASE WHEN turn > 0 THEN turn - 1 WHEN conv_id % 4 = 2 THEN last END AS target FROM conversations JOIN l USING (conv_id)),
 r AS (SELECT conv_id * 1000 + last AS start, conv_id * 1000 + last AS node FROM l UNION SELECT r.start, e.target FROM r JOIN e ON e.source = r.node WHERE e.target IS NOT NULL)
 SELECT start, node FROM r WHERE start <> node UNION SELECT r.start, r.start FROM r JOIN e ON e.source = r.node AND e.target = r.start""",
    "archive_read": f"""{_M} SELECT CAST(conversation AS VARCHAR) AS conversation, event_id AS message_id, speaker, md5(text) AS text,
 CASE WHEN position > 0 THEN CAST(position - 1 AS VARCHAR) END AS parent FROM m""",
    "vectors_updated": f"""{_M}, n AS (SELECT event_id, len(text) * CASE WHEN conversation % 4 = 1 THEN 3 ELSE 1 END AS n FROM m WHERE conversation % 4 IN (1, 3) AND len(text) > 0)
 SELECT event_id AS revision_id, CAST(greatest(ceil((n - 600) / 500.0), 0) AS BIGINT) + 1 AS chunks, CAST(n AS BIGINT) AS "end" FROM n""",
    "lake_import": f"""{_M} SELECT event_id, md5(CASE WHEN conversation % 2 = 0 THEN text || ' (edited)' ELSE text END) AS text, 'resolved' AS state,
 CASE WHEN conversation % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS revisions, 2::BIGINT AS occurrences, CASE WHEN conversation % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS available,
 'unclassified' AS classification, position, true AS at_node FROM m""",
    "lake_index": f"{_M} SELECT token, count(*) AS n FROM (SELECT unnest({_WORDS}) AS token FROM m) GROUP BY token",
    "lake_search_by_index": f"{_M} SELECT event_id, 1::BIGINT AS revisions FROM m WHERE conversation % 2 = 0 AND list_contains({_WORDS}, 'the')",
    "policy_source_reimport": f"""{_M} SELECT 'chatgpt:stays:' || conversation || '-' || position AS event_id, md5(text) AS text FROM m WHERE conversation % 4 = 0
 UNION ALL SELECT 'chatgpt:stays:' || conversation || '-' || position, md5(text || ' (edited)') FROM m WHERE conversation % 4 = 0""",
    "policy_event_reimport": f"""{_M} SELECT event_id, md5(text) AS text, 'classified' AS classification FROM m WHERE position <> 1
 UNION ALL SELECT event_id, md5(text || ' (edited)'), 'unclassified' FROM m WHERE position <> 1 AND conversation % 4 = 3""",
    "hybrid_pages": f"""{_M} SELECT event_id, CASE WHEN conversation % 3 > 0 THEN strftime(created_at, '%Y-%m-%d') END AS day, true AS in_order
 FROM m WHERE contains(s, 'the th')""",
    "lake_restored": f"{_M} SELECT event_id, true AS holds FROM m WHERE (position <> 0 OR conversation % 4 = 3) AND list_contains({_WORDS}, 'the')",
    "ivf_exact": f"""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, {_FAR} AS far FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)
 SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY sqrt(far), vec_id) AS rank FROM p QUALIFY rank <= 10""",
    "ivf_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 5 = 0",
}
