"""Readers of chat exports, agent sessions and notes. JSON is read as variants, so a value's own type decides what it is."""

from __future__ import annotations

import hashlib
import io
import os
import re
import sqlite3
import stat
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.operators import rules

# The roles of the export format, and the prefix of derived ids.
ROLES = {"user": "owner", "assistant": "assistant", "system": "system", "tool": "system"}
DERIVED = "conv-fb-"
# End of the fixed values.
LIMITS = {"members": 10_000, "member_bytes": 512 << 20, "total_bytes": 4 << 30, "ratio": 500}


class ArchiveRejected(ValueError):
    pass


def speaker(role: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[role], F.lit("unknown"))


def check_member(name: str) -> str:
    """A path inside an archive: relative, without drive letters, empty, . or .. parts."""
    path = name.replace("\\", "/")
    if not path or "\0" in path or path[0] in "/~" or re.match(r"[A-Za-z]:", path) or any(p in ("", ".", "..") for p in path.split("/")):
        raise ArchiveRejected(f"unsafe member {name!r}")
    return name


def zip_members(content: bytes, limits: dict[str, int]) -> Iterator[tuple[str, bytes]]:
    """Name and bytes of the members of an archive that keeps all limits; checks come before anything is unpacked."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        for i in infos:
            check_member(i.filename)
            if i.create_system == 3 and stat.S_ISLNK(i.external_attr >> 16):
                raise ArchiveRejected(f"{i.filename!r} is a link")
            if i.file_size > limits["member_bytes"] or i.compress_size and i.file_size > limits["ratio"] * i.compress_size:
                raise ArchiveRejected(f"{i.filename!r} is too large unpacked")
        if len(infos) > limits["members"] or sum(i.file_size for i in infos) > limits["total_bytes"]:
            raise ArchiveRejected("too many or too large members")
        for i in infos:
            data = z.read(i)
            if len(data) != i.file_size:
                raise ArchiveRejected(f"{i.filename!r} isn't as long as it says")
            yield i.filename, data


def archive_members(spark: SparkSession, path: str, limits: dict[str, int] | None = None) -> DataFrame:
    """archive, member, size, sha256, kind (conversations, json, attachment, other) and content of ZIP files or of a folder's files.

    kind conversations is decided by content: a JSON array of objects with a mapping, or one under "conversations".
    """
    limits = LIMITS | (limits or {})
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = content.as_py()
                if raw[:4] == b"PK\3\4":
                    for member, data in zip_members(raw, limits):
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([member]), pa.array([data])], schema=schema)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([os.path.dirname(name.as_py())]), pa.array([check_member(os.path.basename(name.as_py()))]), pa.array([raw])], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    size = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    if size["n"] > limits["members"] or size["bytes"] > limits["total_bytes"]:
        raise ArchiveRejected("too many or too large files")
    out = files.select("path", "content").mapInArrow(run, "archive string, member string, content binary")
    json_ = F.when(F.col("member").endswith(".json"), F.try_parse_json(F.try_validate_utf8(F.col("content").cast("string"))))
    kind = F.when(F.try_variant_get(F.get(conversations_of(json_), 0), "$.mapping", "map<string,variant>").isNotNull(), "conversations").when(json_.isNotNull(), "json").when(F.col("member").endswith(".dat"), "attachment").otherwise("other")
    return out.select("archive", "member", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"), "content")


def archive_sha(members: DataFrame) -> DataFrame:
    """archive and sha256 over its members' names and digests in the order of names."""
    entry = F.array_sort(F.collect_list(F.struct("member", "sha256")))
    return members.groupBy("archive").agg(F.sha2(F.array_join(F.transform(entry, lambda e: F.concat_ws(" ", e["member"], e["sha256"])), "\n"), 256).alias("archive_sha256"))


def conversations_of(document: Column) -> Column:
    """The conversations of an export: an array, one under "conversations", or a single one that stands for itself."""
    one = F.when(F.try_variant_get(document, "$.mapping", "map<string,variant>").isNotNull(), F.array(document))
    return F.coalesce(F.try_variant_get(document, "$", "array<variant>"), F.try_variant_get(document, "$.conversations", "array<variant>"), one)


def kind_of(value: Column) -> Column:
    """string, array, object, number or boolean: the type of a variant."""
    shape = F.schema_of_variant(value)
    return F.when(shape == "STRING", "string").when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").when(shape == "BOOLEAN", "boolean").when(shape != "VOID", "number")


def text_of(content: Column) -> Column:
    """Plain text of a variant that is a string or a list of strings and blocks with a text; what has none is left out."""
    blocks = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda b: F.when(kind_of(b) == "string", b.cast("string")).when(kind_of(F.try_variant_get(b, "$.text", "variant")) == "string", F.try_variant_get(b, "$.text", "string")))
    joined = F.array_join(F.filter(F.transform(blocks, F.trim), lambda t: t.isNotNull() & (t != "")), "\n")
    return F.when(kind_of(content) == "string", content.cast("string")).otherwise(F.coalesce(joined, F.lit("")))


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def _nodes(members: DataFrame) -> DataFrame:
    """members (file, value) as one row for each node: file, c (conversation), node and n (variants)."""
    parsed = members.select("file", F.explode(conversations_of(F.try_parse_json("value"))).alias("c"))
    return parsed.select("file", "c", F.explode(F.try_variant_get("c", "$.mapping", "map<string,variant>")).alias("node", "n"))


def chat_export(spark: SparkSession, path: str, namespace: str, members: DataFrame | None = None) -> DataFrame:
    """One row for each node of each conversation of JSON export files; nodes without a message are structural (null event).

    members, with file and value, is read in place of path. All string parts of a message are its text; parts of other
    types are counted, and pointers among them are its attachments. What can't be read is in export_errors.
    """
    get = lambda v, p, t="string": F.try_variant_get(v, p, t)
    rows = _nodes(_raw(spark, path) if members is None else members)
    c, n = F.col("c"), F.col("n")
    first = F.array_min(F.map_keys(get(c, "$.mapping", "map<string,variant>")))
    derived = F.concat(F.lit(DERIVED), F.substring(F.sha2(F.concat_ws("|", F.coalesce(get(c, "$.title"), F.lit("")), F.coalesce(get(c, "$.create_time"), F.lit("")), first), 256), 1, 16))
    siblings = get(F.element_at(get(c, "$.mapping", "map<string,variant>"), get(n, "$.parent")), "$.children", "array<string>")
    parts = get(n, "$.message.content.parts", "array<variant>")
    texts = F.filter(parts, lambda x: (kind_of(x) == "string") & (x.cast("string") != ""))
    joined = F.nullif(F.array_join(F.transform(texts, lambda x: x.cast("string")), "\n"), F.lit(""))
    text = F.coalesce(joined, F.nullif(get(n, "$.message.content.text"), F.lit("")))
    other = F.filter(parts, lambda x: kind_of(x) != "string")
    pointers = F.filter(F.transform(other, lambda x: get(x, "$.asset_pointer")), lambda p: p.isNotNull())
    time = lambda p: F.timestamp_micros(F.round(get(n, p, "double") * 1_000_000).cast("long"))
    message, has = get(n, "$.message.id"), kind_of(get(n, "$.message", "variant")) == "object"
    return rows.filter(kind_of(n) == "object").select(
        F.coalesce(get(c, "$.conversation_id"), get(c, "$.id"), derived).alias("conversation"), get(c, "$.title").alias("title"), get(c, "$.current_node").alias("current_node"), "node", get(n, "$.parent").alias("parent"),
        (F.array_position(siblings, F.col("node")) - 1).alias("child_order"), F.when(has, F.concat_ws(":", F.lit("chatgpt"), F.lit(namespace), F.coalesce(message, F.col("node")))).alias("event_id"),
        message.alias("message_id"),
        speaker(get(n, "$.message.author.role")).alias("speaker"), time("$.message.create_time").alias("created_at"), time("$.message.update_time").alias("updated_at"), text.alias("text"),
        F.coalesce(get(n, "$.message.content.content_type"), F.lit("text")).alias("content_type"), F.when(F.size(pointers) > 0, F.array_join(pointers, ",")).alias("attachments"),
        F.greatest(F.lit(0), F.coalesce(F.size(other) - F.size(pointers), F.lit(0))).cast("long").alias("n_unsupported"),
    )


def export_errors(spark: SparkSession, path: str) -> DataFrame:
    """file, where and error: files that aren't JSON or hold no conversation, conversations without nodes, nodes that aren't objects."""
    raw = _raw(spark, path).withColumn("v", F.try_parse_json("value"))
    found = conversations_of(F.col("v"))
    error = F.when(F.col("v").isNull(), "MEMBER_NOT_JSON").when(found.isNull() | (F.size(found) == 0), "NO_CONVERSATION_DATA")
    files = raw.select("file", F.lit(None).cast("string").alias("where"), error.alias("error")).filter("error is not null")
    each = raw.select("file", F.posexplode(found).alias("i", "c")).filter(F.try_variant_get("c", "$.mapping", "map<string,variant>").isNull())
    lost = each.select("file", F.col("i").cast("string").alias("where"), F.lit("UNSUPPORTED_CONVERSATION").alias("error"))
    nodes = _nodes(raw.select("file", "value")).filter(F.coalesce(kind_of(F.col("n")) != "object", F.lit(True))).select("file", F.col("node").alias("where"), F.lit("UNSUPPORTED_NODE").alias("error"))
    return files.unionByName(lost).unionByName(nodes)


def epoch_of(value: Column) -> Column:
    """Seconds, milliseconds or ISO text (a variant) as an instant; null where it is none of these."""
    number = F.try_variant_get(value, "$", "double")
    seconds = F.timestamp_micros(F.round(F.when(number > 1e11, number / 1000).otherwise(number) * 1_000_000).cast("long"))
    return F.when(kind_of(value) == "number", seconds).when(kind_of(value) == "string", F.try_to_timestamp(F.try_variant_get(value, "$", "string")))


def chained(rows: DataFrame) -> DataFrame:
    """Messages (conversation, title, stable, role, text, created_at, line) as one chain by time, then line, for each conversation.

    Empty texts and other roles go. A node's id is a digest of conversation and stable id; the last is the current node.
    """
    rows = rows.withColumn("text", F.trim("text")).filter((F.col("text") != "") & F.col("role").isin("user", "assistant"))
    rows = rows.withColumn("node", F.concat(F.lit("n"), F.substring(F.sha1(F.concat_ws(":", "conversation", "stable")), 1, 20)))
    order = Window.partitionBy("conversation").orderBy(F.col("created_at").asc_nulls_first(), "line")
    rows = rows.withColumn("parent", F.lag("node").over(order))
    last = F.last("node").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("conversation", "title", last.alias("current_node"), "node", "parent", F.lit(0).cast("long").alias("child_order"), speaker(F.col("role")).alias("speaker"), "created_at", F.lit(None).cast("timestamp").alias("updated_at"), "text")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file (name without its endings), line and v (variant) of JSON-lines files, compressed ones too; broken lines go."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.jsonl|\.json|\.zst|\.zstd|\.gz)*$", 1).alias("file"), "value")
    return raw.select("file", F.posexplode(F.split("value", "\n")).alias("line", "text")).select("file", "line", F.try_parse_json("text").alias("v")).filter("v is not null")


def _cleaned(rows: DataFrame, source: str) -> DataFrame:
    """Users' texts cleaned by the rules; messages that go are left out, and conversations that a session rule marks."""
    users = rules.cleaned(rows.filter("role = 'user'").withColumn("source", F.lit(source))).drop("source")
    marked = users.filter(F.col("rule").isin(*rules.SESSION_RULES)).select("conversation").distinct()
    kept = users.filter("clean is not null").withColumn("text", F.col("clean")).drop("clean", "rule")
    return kept.unionByName(rows.filter("role <> 'user'")).join(marked, "conversation", "left_anti")


def _titled(rows: DataFrame, prefix: str) -> DataFrame:
    """title: the first user's text, cut, with a prefix, else the prefix and the conversation's id."""
    first = rows.groupBy("conversation").agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("line"))).alias("opening"))
    return rows.drop("title").join(first, "conversation").withColumn("title", F.coalesce(F.concat(F.lit(f"{prefix}: "), F.substring("opening", 1, 38)), F.concat(F.lit(f"{prefix} "), "conversation"))).drop("opening")


def codex_sessions(spark: SparkSession, path: str, threads: DataFrame | None = None) -> DataFrame:
    """Messages of one session a file; sessions of sub-agents, and threads that were imported from elsewhere, go."""
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    lines = _lines(spark, path)
    short = F.regexp_extract("file", r"([^-]*)$", 1)
    lines = lines.withColumn("conversation", F.concat(F.lit("codex-"), short))
    skipped = lines.filter((get("$.type") == "session_meta") & (rules.metadata_rule(F.lit("codex"), F.to_json(get("$.payload", "variant"))) == "codex_subagent_source")).select("conversation").distinct()
    if threads is not None:
        skipped = skipped.union(rules.imported_conversations(threads)).distinct()
    rows = lines.filter((get("$.type") == "response_item") & (get("$.payload.type") == "message")).join(skipped, "conversation", "left_anti")
    rows = rows.select("conversation", F.lit("").alias("title"), F.concat_ws(":", short, "line").alias("stable"), get("$.payload.role").alias("role"), text_of(get("$.payload.content", "variant")).alias("text"), epoch_of(get("$.timestamp", "variant")).alias("created_at"), "line")
    return chained(_titled(_cleaned(rows, "codex"), "codex"))


def claude_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Messages of one session a file; sessions with a side chain go, and meta and summary messages."""
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    lines = _lines(spark, path).filter(get("$.type").isin("user", "assistant"))
    first = F.first(get("$.sessionId"), True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rule = rules.metadata_rule(F.lit("claude"), F.to_json("v"))
    rows = lines.withColumns({"conversation": F.concat(F.lit("claude-"), F.coalesce(first, F.col("file"))), "meta": rule})
    skipped = rows.filter("meta = 'claude_sidechain'").select("conversation").distinct()
    rows = rows.filter("meta is null").join(skipped, "conversation", "left_anti")
    rows = rows.select("conversation", F.lit("").alias("title"), F.coalesce(get("$.uuid"), F.concat_ws(":", "file", "line")).alias("stable"), F.coalesce(get("$.message.role"), get("$.type")).alias("role"), text_of(get("$.message.content", "variant")).alias("text"), epoch_of(get("$.timestamp", "variant")).alias("created_at"), "line")
    return chained(_titled(_cleaned(rows, "claude"), "claude"))


def dsh_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Messages of one session a file, zstd files too; the last title line names it."""
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    every = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = get("$.type")
    lines = _lines(spark, path).withColumns({"sid": F.first(F.when(kind == "session", get("$.id")), True).over(every), "title": F.last(F.when(kind == "session/title", F.nullif(F.trim(get("$.data.title")), F.lit(""))), True).over(every)})
    user = kind == "user/message"
    rows = lines.filter(kind.isin("user/message", "assistant/message") & F.col("sid").isNotNull())
    own = F.when(user, get("$.data.id")).otherwise(get("$.data.message.id"))
    content = F.when(user, get("$.data.content", "variant")).otherwise(get("$.data.message.content", "variant"))
    rows = rows.select(F.concat(F.lit("dsh-"), "sid").alias("conversation"), F.coalesce("title", F.concat(F.lit("dsh-"), "sid")).alias("title"), F.coalesce(own, get("$.seq")).alias("stable"), F.when(user, "user").otherwise("assistant").alias("role"), text_of(content).alias("text"), epoch_of(get("$.time", "variant")).alias("created_at"), "line")
    return chained(_cleaned(rows, "dsh"))


def hermes_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Messages of the conversations in SQLite files; each file is read by the task that gets its bytes."""
    schema = pa.schema([("sid", pa.string()), ("title", pa.string()), ("mid", pa.int64()), ("role", pa.string()), ("content", pa.string()), ("ts", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with tempfile.NamedTemporaryFile(suffix=".db") as f:
                    f.write(content.as_py())
                    f.flush()
                    db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
                    rows = db.execute("SELECT s.id, coalesce(nullif(s.title, ''), s.display_name), m.id, m.role, m.content, m.timestamp FROM sessions s JOIN messages m ON m.session_id = s.id").fetchall()
                    db.close()
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array([v if v is None or i == 2 else str(v) for v in c], t.type) for i, (c, t) in enumerate(zip(columns, schema, strict=True))], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(run, "sid string, title string, mid long, role string, content string, ts string")
    blocks = F.when(F.col("content").startswith("["), F.try_parse_json("content"))
    text = F.when(kind_of(blocks) == "array", text_of(blocks)).otherwise(F.coalesce("content", F.lit("")))
    time = epoch_of(F.coalesce(F.try_parse_json("ts"), F.try_parse_json(F.to_json(F.array("ts")))))
    cid = F.concat(F.lit("hermes-"), "sid")
    return chained(rows.select(cid.alias("conversation"), F.coalesce("title", cid).alias("title"), F.concat(F.lit("m"), F.col("mid").cast("string")).alias("stable"), "role", text.alias("text"), time.alias("created_at"), F.col("mid").alias("line")))


def gemini_export(spark: SparkSession, path: str) -> DataFrame:
    """Messages of page exports; times are the conversation's plus a second a turn, unknown where it has none."""
    get = lambda v, p, t="string": F.try_variant_get(v, p, t)
    conv = _raw(spark, path).select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.conversations", "array<variant>")).alias("c"))
    turns = conv.select("c", F.posexplode(get("c", "$.turns", "array<variant>")).alias("line", "t")).filter(F.trim(get("c", "$.id")) != "")
    base = F.when(kind_of(get("c", "$.created_at", "variant")) == "number", get("c", "$.created_at", "double"))
    text = F.trim(F.make_valid_utf8(F.coalesce(get("t", "$.text"), F.lit(""))))
    rows = turns.select(F.concat(F.lit("gemini-"), F.trim(get("c", "$.id"))).alias("conversation"), F.trim(F.coalesce(get("c", "$.title"), F.lit(""))).alias("title"), get("t", "$.role").alias("role"), text.alias("raw"), F.timestamp_micros(F.round((base + F.col("line")) * 1_000_000).cast("long")).alias("created_at"), "line")
    rows = rows.withColumn("text", F.when(F.col("role") == "user", rules.unlabelled("raw")).otherwise(F.col("raw"))).drop("raw")
    return chained(rows.withColumn("stable", F.concat_ws(":", "line", F.substring(F.sha1(F.concat(F.coalesce("role", F.lit("")), F.lit("\0"), "text")), 1, 12))))


def known_threads(spark: SparkSession, path: str) -> DataFrame:
    """imported_thread_id of an import map's records; a file that isn't there holds none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "imported_thread_id string")
    rows = _raw(spark, path).select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.records", "array<variant>")).alias("r"))
    return rows.select(F.try_variant_get("r", "$.imported_thread_id", "string").alias("imported_thread_id")).filter("imported_thread_id is not null").distinct()


def write_batch(folder: str, source: str, text: str, stamp: str) -> str:
    """A batch file named by its content, written beside and renamed; the same content again is the same file."""
    digest = hashlib.sha256(text.encode()).hexdigest()[:12]
    os.makedirs(f"{folder}/{source}", exist_ok=True)
    held = [f for f in os.listdir(f"{folder}/{source}") if f.endswith(f"-{digest}.json")]
    if held:
        return f"{folder}/{source}/{held[0]}"
    path = f"{folder}/{source}/{stamp}-{digest}.json"
    with open(f"{path}.part", "w") as f:
        f.write(text)
    os.replace(f"{path}.part", path)
    return path
