"""Visibility, search, paging, recall and timeline over messages.

Messages have event_id, revision_id, source, conversation, position, speaker, created_at (null if unknown), text and
search_text. All operators are lazy DataFrame transformations; only what a caller pages through reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from chatlake.functions.text import LOT, first_at, normal, occurrences


def lets_through(scopes: Sequence[str] | None = None, deny: Sequence[str] = (), classified: bool = False) -> Column:
    """Whether the columns scopes and sensitivity pass the limits of visible()."""
    none, out = F.array().cast("array<string>"), F.lit(True)
    if classified:
        out = out & (F.size(F.coalesce("scopes", none)) + F.size(F.coalesce("sensitivity", none)) > 0)
    if scopes is not None:
        out = out & F.coalesce(F.arrays_overlap("scopes", F.array(*map(F.lit, scopes)).cast("array<string>")), F.lit(False))
    if deny:
        out = out & ~F.coalesce(F.arrays_overlap("sensitivity", F.array(*map(F.lit, deny))), F.lit(False))
    return out


def visible(messages: DataFrame, policy: DataFrame | None = None, withdrawn: DataFrame | None = None, scopes: Sequence[str] | None = None, deny: Sequence[str] = (), classified: bool = False, key: str = "revision_id") -> DataFrame:
    """Messages that current policy lets through. policy: key, available, scopes, sensitivity, one row for each key.

    Where there is a policy table, a message without a row in it, or without an available one, is hidden; so are ones of
    withdrawn sources (as source). Without a policy table all are available and unclassified, so a limit of scopes or to
    classified messages lets none through.
    """
    out = messages
    if withdrawn is not None:
        out = out.join(withdrawn.select("source").distinct(), "source", "left_anti")
    if policy is None:
        return out.filter(F.lit(False)) if classified or scopes is not None else out
    rows = policy.filter("available").filter(lets_through(scopes, deny, classified))
    return out.join(rows.select(key), key, "left_semi")


def current_policy(states: DataFrame, key: str = "revision_id", order: str = "version") -> DataFrame:
    """The latest state of each key of an append-only policy log; a withdrawal hides whatever labels came before."""
    last = F.max_by(F.struct(*[c for c in states.columns if c not in (key, order)]), order)
    return states.groupBy(key).agg(last.alias("s")).select(key, "s.*")


def day_bound(day: str, zone: str, end: bool = False) -> Column:
    """The instant at which a local day begins, or the one at which it ends."""
    d = F.to_timestamp(F.lit(day))
    return F.to_utc_timestamp(d + F.expr("interval 1 day") if end else d, zone)


def search(messages: DataFrame, query: str, mode: str = "literal", date_from: Column | None = None, date_to: Column | None = None, speaker: str | None = None) -> DataFrame:
    """Messages that hold the query (literal) or all its words (all_terms), with span_start and score.

    The span is that of the first term; the score counts all terms' occurrences. An empty query is an error.
    """
    terms = [normal(query)] if mode == "literal" else list(dict.fromkeys(normal(query).split()))
    if not terms or not terms[0]:
        raise ValueError("the query is empty")
    out = messages
    if date_from is not None:
        out = out.filter(F.col("created_at") >= date_from)
    if date_to is not None:
        out = out.filter(F.col("created_at") < date_to)
    if speaker is not None:
        out = out.filter(F.col("speaker") == speaker)
    for t in terms:
        out = out.filter(F.col("search_text").contains(t))
    score = sum((occurrences(F.col("search_text"), t) for t in terms[1:]), occurrences(F.col("search_text"), terms[0]))
    return out.withColumns({"span_start": first_at(F.col("search_text"), terms[0]), "score": score})


def order_of(order: str) -> list[Column]:
    known, time = F.col("created_at").isNull(), F.col("created_at")
    if order == "chronological":
        return [known, time.asc_nulls_last(), F.col("event_id")]
    if order == "reverse":
        return [known, time.desc_nulls_last(), F.when(~known, F.col("event_id")).desc_nulls_last(), F.col("event_id")]
    return [F.col("score").desc(), known, time.asc_nulls_last(), F.col("event_id")]


def page(hits: DataFrame, order: str, limit: int) -> DataFrame:
    return hits.orderBy(*order_of(order)).limit(limit)


def recent(events: DataFrame, now: datetime | Column, days: int, limit: int, time: str = "created_at", key: str = "event_id", after: tuple[Column, Column] | None = None) -> DataFrame:
    """Newest first within the days before now; after is the (time, key) of the last row of the page before."""
    now = F.lit(now) if isinstance(now, datetime) else now
    out = events.filter((F.col(time) <= now) & (F.col(time) >= now - F.make_dt_interval(F.lit(days))))
    if after is not None:
        out = out.filter((F.col(time) < after[0]) | ((F.col(time) == after[0]) & (F.col(key) < after[1])))
    return out.orderBy(F.col(time).desc(), F.col(key).desc()).limit(limit)


def current_revision(revisions: DataFrame, key: str = "event", seq: str = "seq", version: str = "version") -> DataFrame:
    """Which revision of each event is current, and whether that is resolved.

    In order of arrival, a row decides when it is the first, when its version beats all before, or when it can't be
    compared or ties (then the event is unresolved). The last deciding row gives the state.
    """
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    rows = revisions.withColumns({"best": F.max(version).over(w), "before": F.count(F.lit(1)).over(w)})
    first, v, m = F.col("before") == 0, F.col(version), F.col("best")
    wins = first | (m.isNotNull() & v.isNotNull() & (v > m))
    unclear = ~first & (v.isNull() | m.isNull() | (v == m))
    rows = rows.withColumn("state", F.when(wins, "resolved").when(unclear, "unresolved")).filter("state is not null")
    last = F.max_by(F.struct("state", seq), seq)
    return rows.groupBy(key).agg(last.alias("s")).select(key, F.col("s.state").alias("state"), F.when(F.col("s.state") == "resolved", F.col(f"s.{seq}")).alias("current_seq"))


def neighbours(hits: DataFrame, messages: DataFrame, radius: int) -> DataFrame:
    """Messages at most radius positions from a hit of their conversation, once each, with whether they are hits."""
    near = hits.select("conversation", F.explode(F.sequence(F.col("position") - radius, F.col("position") + radius)).alias("position"), F.col("position").alias("hit"))
    near = near.groupBy("conversation", "position").agg(F.max(F.col("hit") == F.col("position")).alias("is_hit"))
    return messages.join(near, ["conversation", "position"])


def islands(hits: DataFrame, radius: int) -> DataFrame:
    """Groups of hits of a conversation whose windows touch: a gap of at most 2 * radius + 1 positions."""
    w = Window.partitionBy("conversation").orderBy("position")
    new = F.when(F.col("position") - F.lag("position").over(w) <= 2 * radius + 1, 0).otherwise(1)
    return hits.withColumn("new", new).withColumn("island", F.sum("new").over(w)).drop("new")


def timeline(messages: DataFrame, zone: str, owner: str = "owner") -> DataFrame:
    """Per local day and conversation: messages, the owner's, first and last time, and the owner's first event."""
    rows = messages.filter("created_at is not null").withColumn("day", F.to_date(F.from_utc_timestamp("created_at", zone)))
    own = F.col("speaker") == owner
    return rows.groupBy("day", "conversation").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(own).alias("n_owner"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
        F.min_by(F.when(own, F.col("event_id")), F.when(own, F.struct("created_at", "event_id"))).alias("first_owner"),
    )


def top_per_day(days: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("day").orderBy(F.col("last_at").desc(), F.col("conversation"))
    return days.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def text_budget(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], budget: int, text: str = "text") -> DataFrame:
    """Texts cut where their running length passes a budget; given is the part that is left of each."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    return rows.withColumn("given", F.substring(F.col(text), F.lit(1), F.greatest(F.lit(0), F.lit(budget) - before).cast("int")))


def gap_sessions(rows: DataFrame, key: str, time: str, seconds: int, tie: str) -> DataFrame:
    """session numbers from 1 that go up after each gap longer than the given seconds."""
    w = Window.partitionBy(key).orderBy(time, tie)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    return rows.withColumn("new", F.when(gap <= seconds * 1_000_000, 0).otherwise(1)).withColumn("session", F.sum("new").over(w)).drop("new")


def selected_path(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """Nodes from each conversation's leaf to its root, root depth 0. edges: conversation, node, parent; leaves: conversation, node.

    Each conversation is walked by itself, as far as it goes; a walk that comes to a node again, or to one that isn't there,
    doesn't reach a node without a parent, and the conversation has no path. Of several parents of a node the least counts,
    none before all others.
    """
    kind = {f.name: f.dataType for f in edges.schema.fields}
    parents = edges.groupBy("conversation", "node").agg(F.min(F.struct(F.col("parent").isNotNull(), F.col("parent").alias("parent"))).alias("least"))
    trees = parents.groupBy("conversation").agg(F.collect_list(F.struct("node", F.col("least.parent").alias("parent"))).alias("tree"))
    ends = leaves.select(F.col("conversation").alias("of"), F.col("node").alias("leaf"))
    walked = trees.join(ends, F.col("conversation").eqNullSafe(F.col("of"))).select("conversation", "leaf", "tree")
    out = StructType([StructField("conversation", kind["conversation"]), StructField("path", ArrayType(kind["node"]))])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in (batch.slice(i, LOT) for batch in batches for i in range(0, batch.num_rows, LOT)):
            paths = []
            for at, tree in zip(lot.column(1), lot.column(2), strict=True):
                nodes, parents = (tree.values.field(i).to_pylist() for i in range(2))
                up, node, path = dict(zip(nodes, parents, strict=True)), at.as_py(), []
                while node is not None and node in up:
                    path.append(node)
                    node = up.pop(node)
                paths.append(path[::-1] if path and node is None else [])
            yield pa.RecordBatch.from_arrays([lot.column(0).cast(schema.types[0]), pa.array(paths, schema.types[1])], schema=schema)

    return walked.mapInArrow(run, out).select("conversation", F.posexplode("path").alias("depth", "node")).select("conversation", "node", F.col("depth").cast("long").alias("depth"))
