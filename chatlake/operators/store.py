"""The stored archive: sources, snapshots, conversations, nodes, events' revisions, occurrences, policy and the search index.

A Lake is a folder of Parquet tables and a commit log (see commits). Every change is one commit: readers see whole imports
only, a failed one leaves nothing visible, and of two writers the second builds its change anew on what the first has left.
Revisions are never rewritten; the same content again adds an occurrence and nothing else.

Policy is an append-only log of rows by revision, and one of rows by source. compact() sums the former up; a reader takes the
summary and the few rows after it, so no search groups the whole log. A withdrawn source stays withdrawn: what later imports
bring of it is withdrawn from the start, and its messages are hidden whatever their own rows say.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.functions.text import has_credentials, normalize
from chatlake.operators import ids, partials, policy, postings
from chatlake.operators.archive import current_policy, current_revision, selected_path, visible
from chatlake.operators.commits import Log
from chatlake.operators.scratch import listed

SCHEMAS = {
    "conversations": "snapshot_id string, conv_snapshot_id string, conversation string, title string, current_node string, path_known boolean, publish_seq long",
    "nodes": "conv_snapshot_id string, conversation string, node string, parent string, child_order long, event_id string, depth long",
    "revisions": "revision_id string, event_id string, source_id string, conversation string, node string, speaker string, content_type string, text string, attachments string, search_text string, created_at timestamp, updated_at timestamp, version timestamp, recorded_at timestamp, seq long, doc long",
    "occurrences": "revision_id string, snapshot_id string, locator string, imported_at timestamp",
    "policy": policy.SCHEMA,
    "sources": policy.SOURCES,
    "postings": postings.SCHEMA,
}
#: Tables that are made of others: summaries of the policy log, and partial aggregates.
DERIVED = {"policy_state": policy.SCHEMA, "partials": partials.SCHEMA}
#: Changes of policy after which the log is summed up by the next import.
COMPACT = 16


class Lake(Log):
    def table(self, name: str, after: int = 0) -> DataFrame:
        """All rows of a table, or those of changes after a number."""
        paths = self.folders(name, after)
        schema = (SCHEMAS | DERIVED)[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else listed(self.spark, schema)

    def rows(self, name: str, columns: Sequence[str] | None = None) -> dict[str, Column]:
        """The casts that give a table's columns from columns of the same names."""
        fields = self.spark.createDataFrame([], (SCHEMAS | DERIVED)[name]).schema
        return [F.col(f.name).cast(f.dataType) for f in fields if columns is None or f.name in columns]

    def docs(self) -> int:
        """How many messages have been numbered."""
        return sum(j.get("docs", 0) for j in self.jobs())

    # What queries read.

    def policy(self) -> DataFrame:
        """The current row of each revision: of the summary, where no later change has one."""
        covered = max((j["covers"] for j in self.jobs() if "covers" in j), default=0)
        later = self.parts("policy", covered)
        tail = self.table("policy", covered)
        # a change has one row a revision, but for a backup, which holds the whole log
        single = len(later) == 1 and later[0][0]["kind"] != "backup"
        tail = tail.drop("version") if single else current_policy(tail)
        if not covered:
            return tail
        state = self.table("policy_state").drop("version")
        return state.join(tail.select("revision_id"), "revision_id", "left_anti").unionByName(tail) if later else state

    def withdrawn_sources(self) -> DataFrame:
        """source_id of the sources that are withdrawn now."""
        return current_policy(self.table("sources"), key="source_id").filter("withdrawn").select("source_id")

    def latest_conversations(self) -> DataFrame:
        """The snapshot of each conversation that was published last."""
        w = Window.partitionBy("conversation").orderBy(F.col("publish_seq").desc())
        return self.table("conversations").withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")

    def paths(self) -> DataFrame:
        """conversation, event_id, position of the selected paths of the latest snapshots."""
        latest = self.latest_conversations().filter("path_known").select("conv_snapshot_id")
        return self.table("nodes").filter("depth is not null").join(latest, "conv_snapshot_id", "left_semi").select("conversation", "event_id", F.col("depth").alias("position"), "node")

    def path_unknown(self) -> int:
        return self.latest_conversations().filter("not path_known").count()

    def titles(self, conversations: DataFrame) -> DataFrame:
        return self.latest_conversations().join(conversations.select("conversation").distinct(), "conversation", "left_semi").select("conversation", F.coalesce("title", F.lit("")).alias("title"))

    def current(self) -> DataFrame:
        """event_id, state and current revision (null where versions can't be ordered)."""
        rows = self.table("revisions").select("event_id", "seq", "version", "revision_id")
        state = current_revision(rows, key="event_id")
        return state.join(rows.select("event_id", F.col("seq").alias("current_seq"), F.col("revision_id").alias("current_revision_id")), ["event_id", "current_seq"], "left").select("event_id", "state", "current_revision_id")

    def messages(self, namespace: str | None = None, source: str | None = None, conversation: str | None = None, **filters) -> DataFrame:
        """The visible revisions as messages of the search operators; more filters are those of visible()."""
        rows = self.table("revisions")
        if namespace is not None:
            rows = rows.filter(F.element_at(F.split("event_id", ":"), 2) == namespace)
        if source is not None:
            rows = rows.filter(F.col("source_id") == source)
        if conversation is not None:
            rows = rows.filter(F.col("conversation") == conversation)
        if self.parts("sources"):
            rows = rows.join(self.withdrawn_sources(), "source_id", "left_anti")
        return visible(rows, self.policy(), **filters)

    def representative(self, events: DataFrame, **filters) -> DataFrame:
        """One visible revision of each event: the current one, else the last recorded."""
        rows = self.messages(**filters).join(events.select("event_id").distinct(), "event_id", "left_semi").join(self.current(), "event_id", "left")
        w = Window.partitionBy("event_id").orderBy(F.coalesce(F.col("revision_id") == F.col("current_revision_id"), F.lit(False)).desc(), F.col("recorded_at").desc(), F.col("revision_id").desc())
        return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth", "state", "current_revision_id")

    def provenance(self, revisions: DataFrame) -> DataFrame:
        """revision_id and where it has occurred, earliest first, with the node of the earliest."""
        rows = self.table("occurrences").join(revisions.select("revision_id").distinct(), "revision_id", "left_semi")
        all_ = F.array_sort(F.collect_list(F.struct("imported_at", "snapshot_id", "locator")))
        return rows.groupBy("revision_id").agg(all_.alias("occurrences")).withColumn("node", F.regexp_extract(F.col("occurrences")[0]["locator"], r"#node=(.+)$", 1))

    def indexable(self, **filters) -> DataFrame:
        """Visible revisions with a text that holds no known credential."""
        return self.messages(**filters).filter((F.coalesce(F.length("text"), F.lit(0)) > 0) & ~has_credentials(F.col("text")))


def validate_namespace(namespace: str) -> str:
    if not namespace or len(namespace) > 64 or not all(c.isascii() and (c.isalnum() or c in "_-") for c in namespace):
        raise ValueError("a namespace has 1 to 64 letters, digits, _ or -")
    return namespace


def publish(lake: Lake, nodes: DataFrame, kind: str, namespace: str, archive_sha: str, now: datetime, withdrawn: DataFrame | None = None, errors: Sequence[str] = ()) -> dict:
    """Imports the nodes of an export (the columns of chat_export) as one snapshot.

    The same archive again makes a job of kind duplicate and changes nothing. Nodes with errors leave the import partial.
    Revisions whose content is known add an occurrence; new ones inherit the withdrawal of their event or source. If any
    step fails, a failed job is all that is left. nodes may have message_id (the export's own, null where it has none),
    content_type and attachments (JSON) besides.
    """
    validate_namespace(namespace)
    source, snapshot = ids.name_uuid("source", kind, namespace), ids.name_uuid("snapshot", kind, namespace, archive_sha)
    staged: list[str] = []

    def build(base: Lake, job: dict) -> tuple[dict, dict[str, DataFrame]]:
        if any(j.get("snapshot_id") == snapshot and j["status"] in ("complete", "partial") for j in base.jobs()):
            return {"kind": "duplicate"}, {}
        more, rows = _published(base, nodes, kind, namespace, now, withdrawn, job, staged)
        return more | {"status": "partial" if errors else "complete"}, rows

    try:
        job = lake.change(build, "import", now, snapshot_id=snapshot, source_id=source, sha=archive_sha, errors=len(errors))
    finally:
        for name in staged:
            lake.delete(name)
    if job["kind"] == "import":
        postings.merge(lake, now)
        state = lake.snapshot()
        if len(state.parts("policy", max((j["covers"] for j in state.jobs() if "covers" in j), default=0))) >= COMPACT:
            compact(lake, now)
    return job


def messages_of(nodes: DataFrame, kind: str, namespace: str) -> DataFrame:
    """The nodes with event_id and revision_id, null where they hold no message.

    A message is named by its own id; without one by where it stands, who says it when, and what.
    """
    c, none = F.col, F.lit(None).cast("string")
    have = lambda name, other: c(name) if name in nodes.columns else other
    position = ids.structural_position(c("parent"), c("child_order"))
    fallback = ids.fallback_message_id(kind, namespace, c("conversation"), position, c("speaker"), c("created_at"), ids.content_digest(c("text")))
    native = F.nullif(have("message_id", F.element_at(F.split("event_id", ":", 3), 3)), F.lit(""))
    rows = nodes.withColumns({"content_type": have("content_type", F.lit("text")), "attachments": have("attachments", none)})
    rows = rows.withColumn("event_id", F.when(c("event_id").isNotNull(), ids.event_id(kind, namespace, F.coalesce(native, fallback))))
    hash_ = ids.revision_hash(c("content_type"), c("text"), c("speaker"), c("created_at"), c("updated_at"), c("attachments"))
    return rows.withColumn("revision_id", F.when(c("event_id").isNotNull(), ids.revision_id(c("event_id"), hash_)))


def numbered(lake: Lake, rows: DataFrame, first: int, staged: list[str]) -> tuple[DataFrame, int]:
    """The rows with doc, numbers in a row from first on by time, and how many there are."""
    at = ["created_at", "revision_id"]
    sorted_ = rows.repartitionByRange(*at).sortWithinPartitions(*at)
    sorted_ = sorted_.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    held, name = lake.staged(sorted_)
    staged.append(name)
    sizes = sorted((r["_part"], r["count"]) for r in held.groupBy("_part").count().collect())
    starts = [(p, first + sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    starts = listed(lake.spark, "_part int, _start long", starts)
    out = held.join(F.broadcast(starts), "_part").withColumn("doc", F.col("_start") + F.col("_place"))
    return out.drop("_part", "_place", "_start"), sum(n for _, n in sizes)


def _published(lake: Lake, nodes: DataFrame, kind: str, namespace: str, now: datetime, withdrawn: DataFrame | None, job: dict, staged: list[str]) -> tuple[dict, dict[str, DataFrame]]:
    c, at, snapshot = F.col, F.lit(now), F.lit(job["snapshot_id"])
    rows = messages_of(nodes, kind, namespace).withColumn("conv_snapshot_id", ids.conversation_snapshot(snapshot, c("conversation")))
    rows, name = lake.staged(rows)
    staged.append(name)
    leaves = rows.filter(c("node") == c("current_node")).select("conversation", "node").distinct()
    depth = selected_path(rows.select("conversation", "node", "parent").distinct(), leaves)
    known = depth.select("conversation", F.lit(True).alias("known")).distinct()
    one = [F.first(n, True).alias(n) for n in ("title", "current_node")]
    conversations = rows.groupBy("conversation", "conv_snapshot_id").agg(*one).join(known, "conversation", "left")
    path_known = F.coalesce("known", F.lit(False)).alias("path_known")
    conversations = conversations.select(snapshot.alias("snapshot_id"), "conv_snapshot_id", "conversation", "title", "current_node", path_known, F.lit(job["seq"]).alias("publish_seq"))
    placed = rows.join(depth, ["conversation", "node"], "left")
    messages = rows.filter("event_id is not null")
    each = messages.withColumn("nth", F.row_number().over(Window.partitionBy("revision_id").orderBy("conversation", "node"))).filter("nth = 1")
    new = each.join(lake.table("revisions").select("revision_id"), "revision_id", "left_anti")
    new = new.withColumns({
        "source_id": F.lit(job["source_id"]), "search_text": normalize("text"), "version": F.coalesce("updated_at", "created_at"), "recorded_at": at,
    })
    new, n = numbered(lake, new.select(*lake.rows("revisions", [x for x in new.columns if x not in ("seq", "doc")])), lake.docs(), staged)
    new = new.withColumn("seq", F.lit(job["seq"]) * F.lit(1 << 40) + F.pmod(F.xxhash64("revision_id"), F.lit(1 << 40)))
    locator = F.concat(F.lit("#node="), ids.node_key(c("conversation"), c("node"))).alias("locator")
    occurrences = each.select("revision_id", snapshot.alias("snapshot_id"), locator, at.alias("imported_at"))
    gone = lake.policy().filter("not available").select("revision_id").join(lake.table("revisions").select("revision_id", "event_id"), "revision_id")
    gone = gone.select("event_id", F.lit(None).cast("string").alias("source_id")).distinct()
    gone = gone.unionByName(lake.withdrawn_sources().select(F.lit(None).cast("string").alias("event_id"), "source_id"))
    if withdrawn is not None:
        gone = gone.unionByName(withdrawn.select("event_id", "source_id"))
    first = policy.initial(new, job["seq"], at, gone)
    tables = {"conversations": conversations, "nodes": placed, "revisions": new, "occurrences": occurrences, "policy": first}
    tables["partials"] = partials.added(new, first, job["seq"])
    tables = {t: df.select(*lake.rows(t)) for t, df in tables.items()}
    buckets = postings.buckets_for(n)
    return {"docs": n, "indexed": n, "index_buckets": buckets}, tables | {"postings": postings.postings(new, buckets)}


# Changes of policy.


def _policy_tables(base: Lake, rows: DataFrame, seq: int) -> dict[str, DataFrame]:
    """The policy rows of a change, and the partials of the cells that it touches."""
    rows = rows.select(*base.rows("policy"))
    return {"policy": rows, "partials": partials.touched(base, rows, seq).select(*base.rows("partials"))}


def change_policy(lake: Lake, rows: DataFrame, now: datetime, what: str) -> dict:
    """Appends policy rows that the caller has made as a job of their own; of several of a revision the last counts."""
    rows = rows.select(*lake.rows("policy"))
    rows = rows.groupBy("revision_id").agg(F.max_by(F.struct(*rows.columns), "version").alias("row")).select("row.*")
    return lake.change(lambda base, job: ({}, _policy_tables(base, rows, job["seq"])), what, now)


def withdraw_source(lake: Lake, source: str, now: datetime) -> dict | None:
    """Withdraws a source for good: its revisions, and what later imports bring of it. None if it is withdrawn already."""

    def build(base: Lake, job: dict) -> tuple[dict, dict[str, DataFrame]] | None:
        own = base.table("revisions").filter(F.col("source_id") == source)
        if not any(j.get("source_id") == source for j in base.jobs()) and own.isEmpty():
            raise LookupError("no such source")
        if not base.withdrawn_sources().filter(F.col("source_id") == source).isEmpty():
            return None
        rows = policy.withdraw(base.policy(), own, job["seq"], now, "source", source=source)
        mark = listed(base.spark, "source_id string, version long, withdrawn boolean, reason string", [(source, job["seq"], True, "withdrawn")])
        return {}, _policy_tables(base, rows, job["seq"]) | {"sources": mark.withColumn("recorded_at", F.lit(now)).select(*base.rows("sources"))}

    return lake.change(build, "withdraw", now)


def withdraw_events(lake: Lake, events: DataFrame, now: datetime) -> dict:
    """Withdraws the available revisions of a table of event_id and reason."""

    def build(base: Lake, job: dict) -> tuple[dict, dict[str, DataFrame]]:
        rows = policy.withdraw(base.policy(), base.table("revisions"), job["seq"], now, events=events)
        return {}, _policy_tables(base, rows, job["seq"])

    return lake.change(build, "withdraw", now)


def label(lake: Lake, now: datetime, scopes: Sequence[str], sensitivity: Sequence[str], event: str | None = None, source: str | None = None) -> dict:
    """Replaces the labels of an event's or a source's available revisions."""

    def build(base: Lake, job: dict) -> tuple[dict, dict[str, DataFrame]]:
        rows = policy.relabel(base.policy(), base.table("revisions"), job["seq"], now, scopes, sensitivity, event, source)
        return {}, _policy_tables(base, rows, job["seq"])

    return lake.change(build, "label", now)


def compact(lake: Lake, now: datetime) -> dict | None:
    """Sums the policy log up to here: one row a revision, which readers take in place of the log; the partials likewise.

    Partials that are there are merged by cell; if an older change has none, all are made from the revisions.
    """

    def build(base: Lake, job: dict) -> tuple[dict, dict[str, DataFrame]]:
        old = [j["attempt"] for j, _ in base.parts("policy_state")]
        rows = base.policy().withColumn("version", F.lit(base.head()).cast("long")).select(*base.rows("policy"))
        parts = [j["attempt"] for j, _ in base.parts("partials")]
        whole = partials.summed(base, job["seq"]).select(*base.rows("partials"))
        more = {"covers": base.head(), "partials": base.head(), "drops": {"policy_state": old, "partials": parts}}
        return more, {"policy_state": rows.sort("revision_id"), "partials": whole}

    return lake.change(build, "compact", now)


# What is there, and whether it is sound.


def counts(lake: Lake) -> DataFrame:
    """Rows of each table."""
    out = None
    for name in SCHEMAS:
        one = lake.table(name).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def indexed(lake: Lake) -> DataFrame:
    """doc of all messages that the index holds."""
    rows = lake.table("postings").select("block", F.explode("docs").alias("place"))
    return rows.select((F.shiftleft("block", postings.BLOCK_BITS) + F.col("place")).alias("doc")).distinct()


def status(lake: Lake) -> dict:
    """Imports by status, rows by table, and the visible revisions that lack search tokens."""
    lake = lake.snapshot()
    jobs = [j for j in lake.jobs() if j["kind"] not in ("merge", "compact")]
    missing = lake.messages().filter("length(search_text) > 0").join(indexed(lake), "doc", "left_anti").count()
    by = {s: sum(j["status"] == s for j in jobs) for s in ("complete", "partial", "failed")}
    return {"jobs": by, "tables": {r["table"]: r["rows"] for r in counts(lake).collect()}, "path_unknown": lake.path_unknown(), "unindexed": missing}


def restore_check(lake: Lake) -> dict[str, int]:
    """Rows whose references lead nowhere, by table; all 0 in a sound copy."""
    lake = lake.snapshot()
    r, one = lake.table("revisions"), lambda df: df.count()
    return {
        "occurrences": one(lake.table("occurrences").join(r, "revision_id", "left_anti")),
        "policy": one(lake.table("policy").join(r, "revision_id", "left_anti")),
        "postings": one(indexed(lake).join(r, "doc", "left_anti")),
        "nodes": one(lake.table("nodes").filter("event_id is not null").join(r, "event_id", "left_anti")),
        "revisions_without_policy": one(r.join(lake.table("policy"), "revision_id", "left_anti")),
    }


# Backups.

_SUMS = "name string, file string, rows long, hash decimal(38,0)"


def file_sums(lake: Lake) -> DataFrame:
    """name, file, rows and an order-free sum of the rows' hashes of each file of each table."""
    out = None
    for name in (*SCHEMAS, *DERIVED):
        if lake.parts(name):
            df = lake.table(name)
            file = F.regexp_replace(F.input_file_name(), r"^.*/data/", "")
            one = df.select(file.alias("file"), F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h"))
            one = one.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.sum("h").cast("decimal(38,0)").alias("hash"))
            one = one.select(F.lit(name).alias("name"), "file", "rows", "hash")
            out = one if out is None else out.unionByName(one)
    return out if out is not None else lake.spark.createDataFrame([], _SUMS)


def backup(lake: Lake, folder: str, now: datetime) -> dict:
    """An archive by itself at folder/TIME with all that this one holds, then a manifest of its files' checksums.

    The changes keep their numbers and figures; the rows are written anew, by one last change, and each folder once.
    """
    state = lake.snapshot()
    target = Lake(lake.spark, f"{folder.rstrip('/')}/{now:%Y%m%dT%H%M%S}")
    if target.listed(""):
        raise FileExistsError(target.root)
    for job in state.jobs():
        target.commit({k: v for k, v in job.items() if k not in ("tables", "drops", "covers", "partials", "docs", "indexed")})

    def build(base: Lake, job: dict) -> tuple[dict, dict[str, DataFrame]]:
        tables = {name: state.table(name) for name in SCHEMAS if state.parts(name) and name != "postings"}
        n = state.docs()
        more = {"docs": n, "indexed": n, "index_buckets": postings.buckets_for(n)}
        if state.parts("postings"):
            tables["postings"] = postings.merged(state.table("postings"), postings.buckets_for(n))
        return more, tables | {"partials": partials.summed(state, job["seq"]).select(*state.rows("partials"))}

    target.change(build, "backup", now)
    file_sums(target).select("name", "file", "rows", "hash").write.parquet(f"{target.root}/manifest")
    return {"path": target.root, "at": now.isoformat(), "head": state.head()}


def backup_faults(spark: SparkSession, path: str) -> DataFrame:
    """name and file of a backup's files that aren't as its manifest says: missing, added, or of other rows."""
    told, found = spark.read.schema(_SUMS).parquet(f"{path}/manifest"), file_sums(Lake(spark, path))
    same = ["name", "file", "rows", "hash"]
    odd = told.select(same).exceptAll(found.select(same)).unionByName(found.select(same).exceptAll(told.select(same)))
    return odd.select("name", "file").distinct()


def backup_check(spark: SparkSession, path: str) -> bool:
    """Whether a backup holds what its manifest says."""
    return backup_faults(spark, path).isEmpty()


def prune_backups(spark: SparkSession, folder: str, keep: int, protect: Sequence[str] = ()) -> list[str]:
    """Deletes all but the newest keep complete backups (those with a manifest), and never a protected one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((s.getPath().toString() for s in fs.listStatus(hadoop(folder)) if fs.exists(hadoop(f"{s.getPath()}/manifest/_SUCCESS"))), reverse=True)
    gone = [p for p in found[max(keep, 0) :] if p.rsplit("/", 1)[-1] not in protect]
    for p in gone:
        fs.delete(hadoop(p), True)
    return gone


def at_time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
