"""Queries of the archive operators over the star-schema test tables, and equal SQL for a second engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.functions import text as X
from chatlake.operators import archive as A
from chatlake.operators import rules as R
from chatlake.operators import semantic as V
from chatlake.operators import facts, postings
from chatlake.plans.stored import rows_of, stored
from chatlake.sources.exports import speaker

QUERY_VECTOR = [round(((i * 37) % 19 - 9) / 40, 4) for i in range(64)]
ZONE = "Asia/Shanghai"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    """conversations as stored messages with their normal form; an import makes that once, queries only read it."""
    return stored(spark, d, "conversations", "messages", lambda: imported(spark, d), ["created_at", "event_id"], "doc")


def imported(spark: SparkSession, d: str) -> DataFrame:
    """conversations as messages, with a time made of ids: conv_id hours and turn minutes after the start of 2024."""
    c = table(spark, d, "conversations")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return c.select(F.concat(F.lit("chatgpt:driver:"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("event_id"), F.col("conv_id").alias("conversation"), F.col("turn").alias("position"), speaker(F.col("role")).alias("speaker"), at.alias("created_at"), "text", X.normalize("text").alias("search_text"))


def token_index(spark: SparkSession, d: str) -> DataFrame:
    """The index rows of the messages, sorted by token: a query skips to its own by the files' footers."""
    m = messages(spark, d)
    build = lambda: postings.postings(m, 1).drop("bucket")
    return stored(spark, d, "conversations", "token_index", build, ["token", "block"])


#: Bytes of message numbers that a query broadcasts.
NUMBERS = 32 << 20


def by_numbers(rows: DataFrame, index: DataFrame, words: Sequence[str], most: int) -> DataFrame:
    """The messages that hold all words, by their numbers from the index.

    most: rows there are at all. If so many numbers may not be broadcast, the rarest word's frequency tells whether these may.
    """
    held = index.filter(F.col("token").isin(*words))
    docs = postings.holding_all(held, words, several=False)
    if most * 8 > NUMBERS:
        most = min([r["n"] for r in held.groupBy("token").agg(F.sum("n").alias("n")).collect()], default=0)
    return rows.join(F.broadcast(docs) if most * 8 <= NUMBERS else docs, "doc", "left_semi")


MESSAGES = """m AS (SELECT 'chatgpt:driver:' || conv_id || '-' || turn AS event_id, conv_id AS conversation, turn AS position,
  CASE role WHEN 'user' THEN 'owner' WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' WHEN 'tool' THEN 'system' ELSE 'unknown' END AS speaker,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS created_at, text, replace(lower(text), 'ß', 'ss') AS s FROM conversations)"""
COUNT = "(len({c}) - len(replace({c}, '{t}', ''))) // {n}"


def count_sql(term: str) -> str:
    return "(" + COUNT.format(c="s", t=term, n=len(term)) + ")"


def policies(spark: SparkSession, d: str) -> DataFrame:
    """labels as a policy log: good documents are in scope public, others in scope review; toxic ones are sensitive."""
    states = table(spark, d, "labels").select(F.col("doc_id").alias("revision_id"), F.lit(1).alias("version"), F.lit(True).alias("available"), F.array(F.when(F.col("quality") == 1, "public").otherwise("review")).alias("scopes"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("sensitivity"))
    return A.current_policy(states)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("revision_id", F.col("doc_id"))


def hits(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "span_start", "score")


def search_literal_chrono(spark, d):
    return hits(A.page(A.search(messages(spark, d), "The th"), "chronological", 10))


def search_all_terms_relevance(spark, d):
    return hits(A.page(A.search(messages(spark, d), "and the", "all_terms"), "relevance", 10))


def search_reverse_chrono(spark, d):
    return hits(A.page(A.search(messages(spark, d), "en"), "reverse", 15))


def search_speaker_date_filter(spark, d):
    found = A.search(messages(spark, d), "er", date_from=A.day_bound("2024-01-02", ZONE), date_to=A.day_bound("2024-01-03", ZONE, end=True), speaker="owner")
    return hits(found)


def search_undated_count(spark, d):
    m = messages(spark, d).withColumn("created_at", F.when(F.col("speaker") != "assistant", F.col("created_at")))
    return A.search(m, "en").agg(F.count_if(F.col("created_at").isNull()).alias("undated"), F.count(F.lit(1)).alias("found"))


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _recent(spark, d, after=None):
    now = F.lit("2024-01-25 00:00:00").cast("timestamp")
    return A.recent(events(spark, d), now, 7, 20, "ts", "event_id", after).select("event_id", "user_id")


def recent_window(spark, d):
    return _recent(spark, d)


def recent_keyset_page2(spark, d):
    e = events(spark, d)
    now = F.lit("2024-01-25 00:00:00").cast("timestamp")
    last = A.recent(e, now, 7, 20, "ts", "event_id").orderBy("ts", "event_id").first()
    return _recent(spark, d, (F.lit(last["ts"]), F.lit(last["event_id"])))


def coverage_minmax(spark, d):
    return messages(spark, d).groupBy("speaker").agg(F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("last_at"))


def status_counts(spark, d):
    return messages(spark, d).groupBy("speaker").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("conversation").alias("conversations"), F.sum(F.length("text")).alias("chars"))


def policy_scope_allow(spark, d):
    return A.visible(documents(spark, d), policies(spark, d), scopes=["public"]).select("doc_id")


def policy_sensitivity_deny(spark, d):
    return A.visible(documents(spark, d), policies(spark, d), deny=["toxic"]).select("doc_id")


def policy_classified_only(spark, d):
    """Documents with a row of policy that names a scope or a sensitivity: poor ones that aren't toxic have neither here."""
    rows = policies(spark, d).withColumn("scopes", F.filter("scopes", lambda s: s == "public"))
    return A.visible(documents(spark, d), rows, classified=True).select("doc_id")


def withdrawn_source_hidden(spark, d):
    gone = spark.createDataFrame([("src0",)], "source string")
    return A.visible(documents(spark, d), withdrawn=gone).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def current_revision(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("event"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.floor("value").cast("long")).alias("version"))
    return A.current_revision(rows)


def selected_path_depth(spark, d):
    """Chains, trees whose turns hang two above, circles and dangling parents, by conversation."""
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("conversation"), F.col("turn").alias("node"))
    last = m.groupBy("conversation").agg(F.max("node").alias("last"))
    kind, up = F.col("conversation") % 4, F.col("node") - 1
    parent = F.when(F.col("node") > 0, F.when(kind == 1, F.greatest(F.lit(0), up - 1)).otherwise(up)).when(kind == 2, F.col("last")).when(kind == 3, F.lit(999))
    edges = m.join(last, "conversation").select("conversation", "node", parent.cast("long").alias("parent"))
    return A.selected_path(edges, last.withColumnRenamed("last", "node"))


def context_neighbours(spark, d):
    m = messages(spark, d)
    return A.neighbours(A.search(m, "the th"), m, 1).select("event_id", "is_hit")


def recall_islands(spark, d):
    return A.islands(A.search(messages(spark, d), "the"), 1).groupBy("conversation", "island").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("low"), F.max("position").alias("high"))


def _day(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def timeline_day_conversation(spark, d):
    t = A.timeline(messages(spark, d), ZONE)
    return _day(t).select("day", "conversation", "n", "n_owner", "first_owner")


def timeline_topn_per_day(spark, d):
    t = A.top_per_day(A.timeline(messages(spark, d), ZONE), 3)
    return _day(t).select("day", "conversation", F.col("rank").cast("long").alias("rank"))


def bigram_jaccard_pairs(spark, d):
    """Pairs of benchmark texts whose bigrams are similar enough to ask for their relation; they meet in a rare bigram."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), F.lit("goal").alias("memory_type"), X.normalize("text").alias("search"))
    return facts.similar_claims(b, b, facts.RELATED).filter("new_id < old_id").select(F.col("new_id").alias("item_id"), F.col("old_id").alias("other_id"))


def token_index_prefilter(spark, d):
    """Events by the index alone: the texts aren't read."""
    m = messages(spark, d).select("event_id", "doc")
    return by_numbers(m, token_index(spark, d), ["the", "and"], rows_of(spark, d, "messages")).select("event_id")


def chunk_spans(spark, d):
    return documents(spark, d).select("doc_id", F.explode(X.chunk_spans(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.end")


def knn_topk(spark, d):
    return V.nearest(table(spark, d, "embeddings"), QUERY_VECTOR, 10).select("vec_id", F.col("rank").cast("long").alias("rank"))


def knn_filtered(spark, d):
    return V.nearest(table(spark, d, "embeddings").filter("label = 1"), QUERY_VECTOR, 5).select("vec_id", F.col("rank").cast("long").alias("rank"))


def knn_int8_rerank(spark, d):
    """Over vectors that are packed once; the coarse pass reads their bytes."""
    packed = stored(spark, d, "embeddings", "packed", lambda: V.packed_vectors(table(spark, d, "embeddings").select("vec_id", "embedding")))
    return V.nearest_packed(packed, QUERY_VECTOR, 5, 4).select("vec_id", F.col("rank").cast("long").alias("rank"))


def rrf_fusion(spark, d):
    near = V.nearest(table(spark, d, "embeddings"), QUERY_VECTOR, 20).select(F.col("vec_id").alias("id"), "rank")
    long = documents(spark, d).orderBy(F.col("n_chars").desc(), "doc_id").limit(20)
    long = long.select(F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy(F.col("n_chars").desc(), "doc_id")).alias("rank"))
    return V.fused([near, long], "id").select("id", F.col("fused_rank").cast("long").alias("fused_rank"), F.col("lists").cast("long").alias("lists"))


def credential_filter(spark, d):
    return documents(spark, d).filter(X.has_credentials(F.col("text"))).select("doc_id", F.length(X.mask_credentials("text")).cast("long").alias("masked_chars"))


def round_robin_federation(spark, d):
    notes = table(spark, d, "pages").select(F.lit(0).alias("src"), F.col("page_id").alias("id"), F.row_number().over(Window.orderBy("page_id")).alias("rank")).filter("rank <= 10")
    m = messages(spark, d).select(F.lit(1).alias("src"), F.col("conversation").alias("id"), "position").filter("position = 0")
    m = m.select("src", "id", F.row_number().over(Window.orderBy("id")).alias("rank")).filter("rank <= 10")
    both = notes.unionByName(m)
    return both.withColumn("place", F.row_number().over(Window.orderBy("rank", "src")).cast("long")).select("src", "id", "place")


def running_text_budget(spark, d):
    return A.text_budget(messages(spark, d), ["conversation"], ["position"], 500).select("event_id", F.length("given").cast("long").alias("given"))


def gap_sessions(spark, d):
    s = A.gap_sessions(events(spark, d), "user_id", "ts", 3600 * 12, "event_id")
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def injected_prefix_rules(spark, d):
    """The real rules over owners' messages in front of which every third conversation has a mark of a tool."""
    return R.counters(R.plan(_marked(spark, d)))


def _marked(spark, d):
    m = messages(spark, d).withColumn("source", F.element_at(F.array(F.lit("codex"), F.lit("claude"), F.lit("dsh")), (F.col("conversation") % 3 + 1).cast("int")))
    mark = F.when(F.col("conversation") % 9 == 0, "  # AGENTS.md instructions\n").when(F.col("conversation") % 9 == 3, "The following is the Codex agent history\n").when(F.col("conversation") % 9 == 1, "<system-reminder>x</system-reminder> ").when(F.col("conversation") % 9 == 2, "Current runtime context\n")
    text = F.when(F.col("conversation") % 18 == 1, F.lit("<command-name>a</command-name>\n<system-reminder>x</system-reminder>")).otherwise(F.concat(F.coalesce(mark, F.lit("")), "text"))
    return m.withColumn("text", F.when(F.col("position") == 0, text).otherwise(F.col("text")))


def snippet_offsets(spark, d):
    found = A.search(messages(spark, d), "the th")
    return found.select("event_id", X.snippet(F.col("search_text"), F.col("span_start"), 40).alias("snippet"))


def event_windows(spark, d):
    from chatlake.streaming.inbox import windowed_counts

    return windowed_counts(events(spark, d), "ts", "event_type", "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


NAMES = """search_literal_chrono search_all_terms_relevance search_reverse_chrono search_speaker_date_filter search_undated_count recent_window
recent_keyset_page2 coverage_minmax status_counts policy_scope_allow policy_sensitivity_deny policy_classified_only withdrawn_source_hidden
current_revision selected_path_depth context_neighbours recall_islands timeline_day_conversation timeline_topn_per_day bigram_jaccard_pairs
token_index_prefilter chunk_spans knn_topk knn_filtered knn_int8_rerank rrf_fusion credential_filter round_robin_federation running_text_budget
gap_sessions injected_prefix_rules snippet_offsets event_windows""".split()
QUERIES = {name: globals()[name] for name in NAMES}

_Q = "[" + ", ".join(map(str, QUERY_VECTOR)) + "]"
_DIST = f"sqrt(list_sum([(embedding[i]::DOUBLE - ({_Q}::DOUBLE[])[i]) ** 2 FOR i IN range(1, 65)]))"
_NEAR = f"SELECT vec_id, row_number() OVER (ORDER BY {_DIST}, vec_id) AS rank FROM embeddings"
_LOCAL = "CAST(created_at + INTERVAL 8 HOUR AS DATE)"
_BI = "list_distinct([substr(s, i, 2) FOR i IN range(1, greatest(len(s) - 1, 1) + 1)])"
SQL = {
    "search_literal_chrono": f"WITH {MESSAGES} SELECT event_id, CAST(instr(s, 'the th') - 1 AS BIGINT) AS span_start, CAST({count_sql('the th')} AS BIGINT) AS score FROM m WHERE contains(s, 'the th') ORDER BY created_at, event_id LIMIT 10",
    "search_all_terms_relevance": f"WITH {MESSAGES} SELECT event_id, CAST(instr(s, 'and') - 1 AS BIGINT) AS span_start, CAST({count_sql('and')} + {count_sql('the')} AS BIGINT) AS score FROM m WHERE contains(s, 'and') AND contains(s, 'the') ORDER BY score DESC, created_at, event_id LIMIT 10",
    "search_reverse_chrono": f"WITH {MESSAGES} SELECT event_id, CAST(instr(s, 'en') - 1 AS BIGINT) AS span_start, CAST({count_sql('en')} AS BIGINT) AS score FROM m WHERE contains(s, 'en') ORDER BY created_at DESC, event_id DESC LIMIT 15",
    "search_speaker_date_filter": f"WITH {MESSAGES} SELECT event_id, CAST(instr(s, 'er') - 1 AS BIGINT) AS span_start, CAST({count_sql('er')} AS BIGINT) AS score FROM m WHERE contains(s, 'er') AND speaker = 'owner' AND created_at >= TIMESTAMP '2024-01-01 16:00:00' AND created_at < TIMESTAMP '2024-01-03 16:00:00'",
    "search_undated_count": f"WITH {MESSAGES} SELECT count(*) FILTER (WHERE speaker = 'assistant') AS undated, count(*) AS found FROM m WHERE contains(s, 'en')",
    "recent_window": "SELECT event_id, user_id FROM events WHERE ts <= TIMESTAMP '2024-01-25' AND ts >= TIMESTAMP '2024-01-18' ORDER BY ts DESC, event_id DESC LIMIT 20",
    "recent_keyset_page2": "SELECT event_id, user_id FROM events WHERE ts <= TIMESTAMP '2024-01-25' AND ts >= TIMESTAMP '2024-01-18' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20",
    "coverage_minmax": f"WITH {MESSAGES} SELECT speaker, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM m GROUP BY speaker",
    "status_counts": f"WITH {MESSAGES} SELECT speaker, count(*) AS messages, count(DISTINCT conversation) AS conversations, CAST(sum(len(text)) AS BIGINT) AS chars FROM m GROUP BY speaker",
    "policy_scope_allow": "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1",
    "policy_sensitivity_deny": "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic <> 1",
    "policy_classified_only": "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 OR toxic = 1",
    "withdrawn_source_hidden": "SELECT source, count(*) AS n FROM documents WHERE source <> 'src0' GROUP BY source",
    "current_revision": """WITH r AS (SELECT user_id AS event, event_id AS seq, CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS BIGINT) END AS v FROM events),
 b AS (SELECT *, max(v) OVER w AS m, count(*) OVER w AS k FROM r WINDOW w AS (PARTITION BY event ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s AS (SELECT *, CASE WHEN k = 0 OR v > m THEN 'resolved' WHEN v IS NULL OR m IS NULL OR v = m THEN 'unresolved' END AS state FROM b)
 SELECT event, arg_max(state, seq) AS state, CASE WHEN arg_max(state, seq) = 'resolved' THEN max(seq) END AS current_seq FROM s WHERE state IS NOT NULL GROUP BY event""",
    "selected_path_depth": """WITH RECURSIVE l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
 e AS (SELECT c.conv_id, turn AS node, CASE WHEN turn > 0 THEN CASE WHEN conv_id % 4 = 1 THEN greatest(0, turn - 2) ELSE turn - 1 END WHEN conv_id % 4 = 2 THEN last WHEN conv_id % 4 = 3 THEN 999 END AS parent FROM conversations c JOIN l USING (conv_id)),
 w AS (SELECT conv_id, last AS node, 0 AS k FROM l UNION ALL SELECT w.conv_id, e.parent, k + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.node = w.node WHERE e.parent IS NOT NULL AND k < 200),
 r AS (SELECT w.conv_id, max(k) AS top FROM w JOIN e USING (conv_id, node) WHERE e.parent IS NULL GROUP BY w.conv_id)
 SELECT conv_id AS conversation, node, CAST(top - k AS BIGINT) AS depth FROM w JOIN r USING (conv_id)""",
    "context_neighbours": f"WITH {MESSAGES}, h AS (SELECT conversation, position FROM m WHERE contains(s, 'the th')) SELECT event_id, bool_or(h.position = m.position) AS is_hit FROM m JOIN h ON m.conversation = h.conversation AND abs(m.position - h.position) <= 1 GROUP BY event_id",
    "recall_islands": f"WITH {MESSAGES}, h AS (SELECT conversation, position, CASE WHEN position - lag(position) OVER (PARTITION BY conversation ORDER BY position) <= 3 THEN 0 ELSE 1 END AS new FROM m WHERE contains(s, 'the')), i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conversation ORDER BY position) AS BIGINT) AS island FROM h) SELECT conversation, island, count(*) AS n, min(position) AS low, max(position) AS high FROM i GROUP BY ALL",
    "timeline_day_conversation": f"WITH {MESSAGES} SELECT strftime({_LOCAL}, '%Y-%m-%d') AS day, conversation, count(*) AS n, count(*) FILTER (WHERE speaker = 'owner') AS n_owner, arg_min(event_id, (created_at, event_id)) FILTER (WHERE speaker = 'owner') AS first_owner FROM m GROUP BY {_LOCAL}, conversation",
    "timeline_topn_per_day": f"WITH {MESSAGES}, t AS (SELECT {_LOCAL} AS day, conversation, max(created_at) AS last_at FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY last_at DESC, conversation) AS rank FROM t) SELECT strftime(day, '%Y-%m-%d') AS day, conversation, rank FROM r WHERE rank <= 3",
    "bigram_jaccard_pairs": f"WITH b AS (SELECT item_id, {_BI} AS g FROM (SELECT item_id, replace(lower(text), 'ß', 'ss') AS s FROM benchmark)) SELECT a.item_id, c.item_id AS other_id FROM b a JOIN b c ON a.item_id < c.item_id WHERE 20 * len(list_intersect(a.g, c.g)) >= 9 * (len(a.g) + len(c.g) - len(list_intersect(a.g, c.g)))",
    "token_index_prefilter": f"WITH {MESSAGES} SELECT event_id FROM m WHERE list_contains(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+'), 'the') AND list_contains(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+'), 'and')",
    "chunk_spans": "SELECT doc_id, CAST(i * 500 AS BIGINT) AS start, CAST(least(len(text), i * 500 + 600) AS BIGINT) AS \"end\" FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((len(text) - 600) / 500.0), 0) AS BIGINT) + 1)) AS i FROM documents WHERE len(text) > 0)",
    "knn_topk": f"SELECT * FROM ({_NEAR}) WHERE rank <= 10",
    "knn_filtered": f"SELECT * FROM ({_NEAR} WHERE label = 1) WHERE rank <= 5",
    "knn_int8_rerank": f"""WITH s AS (SELECT 127.0::DOUBLE / max(list_max([abs(x) FOR x IN embedding])) AS scale FROM embeddings),
 c AS (SELECT vec_id, embedding, list_sum([CAST((greatest(-128, least(127, round_even(embedding[i]::DOUBLE * scale, 0))) - greatest(-128, least(127, round_even(({_Q}::DOUBLE[])[i] * scale, 0)))) ** 2 AS BIGINT) FOR i IN range(1, 65)]) AS coarse FROM embeddings, s ORDER BY coarse, vec_id LIMIT 20)
 SELECT * FROM (SELECT vec_id, row_number() OVER (ORDER BY {_DIST}, vec_id) AS rank FROM c) WHERE rank <= 5""",
    "rrf_fusion": f"WITH a AS (SELECT vec_id AS id, rank FROM ({_NEAR}) WHERE rank <= 20), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE rank <= 20), f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS lists FROM u GROUP BY id) SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS fused_rank, lists FROM f",
    "credential_filter": f"SELECT doc_id, CAST(len(text) AS BIGINT) AS masked_chars FROM documents WHERE regexp_matches(text, '{X.CREDENTIAL.replace(chr(39), chr(39) * 2)}')",
    "round_robin_federation": "WITH u AS (SELECT 0 AS src, page_id AS id, row_number() OVER (ORDER BY page_id) AS rank FROM pages UNION ALL SELECT 1, conv_id, row_number() OVER (ORDER BY conv_id) FROM conversations WHERE turn = 0) SELECT src, id, row_number() OVER (ORDER BY rank, src) AS place FROM u WHERE rank <= 10",
    "running_text_budget": f"WITH {MESSAGES} SELECT event_id, CAST(least(len(text), greatest(0, 500 - coalesce(sum(len(text)) OVER (PARTITION BY conversation ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS given FROM m",
    "gap_sessions": "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 43200000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY ALL",
    "injected_prefix_rules": """WITH m AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' ELSE 'dsh' END AS source,
  CASE WHEN turn > 0 THEN text WHEN conv_id % 18 = 1 THEN '<command-name>a</command-name>' || chr(10) || '<system-reminder>x</system-reminder>' ELSE CASE conv_id % 9 WHEN 0 THEN '  # AGENTS.md instructions' || chr(10) WHEN 3 THEN 'The following is the Codex agent history' || chr(10) WHEN 1 THEN '<system-reminder>x</system-reminder> ' WHEN 2 THEN 'Current runtime context' || chr(10) ELSE '' END || text END AS text, turn, role FROM conversations),
 r AS (SELECT *, CASE WHEN turn = 0 THEN CASE WHEN conv_id % 18 = 1 THEN 'command_name_block' WHEN conv_id % 9 = 0 THEN 'codex_agents_md' WHEN conv_id % 9 = 2 THEN 'dsh_runtime_context' END END AS own, bool_or(turn = 0 AND conv_id % 9 = 3 AND role = 'user') OVER (PARTITION BY conv_id) AS session FROM m)
 SELECT source, CASE WHEN session THEN 'codex_guardian_history' ELSE own END AS rule, count(*) AS n, CAST(sum(len(text)) AS BIGINT) AS chars FROM r WHERE role = 'user' AND (session OR own IS NOT NULL) GROUP BY ALL""",
    "snippet_offsets": f"WITH {MESSAGES}, h AS (SELECT *, greatest(instr(s, 'the th') - 1 - 20, 0) AS b FROM m WHERE contains(s, 'the th')) SELECT event_id, CASE WHEN b > 0 THEN '…' ELSE '' END || substr(s, b + 1, 40) || CASE WHEN b + 40 < len(s) THEN '…' ELSE '' END AS snippet FROM h",
    "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
