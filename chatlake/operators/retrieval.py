"""The composed queries of an archive: search with pages and coverage, one event with its context, recall and timeline.

Everything up to a page is a DataFrame; what a caller gets is a page, bounded by its limit, so it is collected and put in
an envelope with coverage, warnings and the next cursor. What policy hides is as if it weren't there.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from chatlake.functions.text import bigrams_of, cjk_runs, mask_credentials, masked_text, normal, normal_map
from chatlake.operators import archive, ids, partials, policy, postings, semantic
from chatlake.operators.scratch import written
from chatlake.operators.store import Lake

ORDERS, MODES = ("chronological", "reverse", "relevance"), ("literal", "all_terms")


class QueryTooBroad(ValueError):
    pass


def plan_term(term: str) -> list[str]:
    """The index tokens every match of a term must have; none where a run of Chinese has a single character, or there is none."""
    runs = cjk_runs(term)
    return [] if not runs or any(len(r) < 2 for r in runs) else [t for r in runs for t in bigrams_of(r)]


def terms_of(query: str, mode: str) -> list[str]:
    terms = [normal(query)] if mode == "literal" else list(dict.fromkeys(normal(query).split()))
    if not terms or not terms[0]:
        raise ValueError("the query is empty")
    return terms


def encode(values: Sequence[object]) -> str:
    return base64.urlsafe_b64encode(json.dumps([v.isoformat() if isinstance(v, datetime) else v for v in values]).encode()).decode()


def decode(cursor: str, n: int) -> list[object]:
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor))
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if not isinstance(values, list) or len(values) != n:
        raise ValueError("not a cursor")
    return values


def keys_of(order: str, hybrid: bool = False) -> list[tuple[Column, bool]]:
    """(column, whether it goes down) of an order, by which rows are sorted and cursors compared; no two rows are alike.

    Times that aren't known come last. With hybrid scores these part equal times; relevance then falls back to exact.
    """
    undated, time, event = F.col("created_at").isNull(), F.unix_micros("created_at"), F.col("event_id")
    score, last = (F.col("score"), True), (F.col("revision_id"), False)
    if order == "relevance":
        exact = [(F.coalesce("exact", F.lit(-1)), True)] if hybrid else []
        return [score, *exact, (undated, False), (time, False), (event, False), last]
    between = [score] if hybrid else []
    if order == "reverse":
        dated_event = F.when(~undated, event)
        return [(undated, False), (time, True), *between, (dated_event, True), (event, False), last]
    return [(undated, False), (time, False), *between, (event, False), last]


def sorted_by(keys: Sequence[tuple[Column, bool]]) -> list[Column]:
    return [c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in keys]


def key_values(keys: Sequence[tuple[Column, bool]]) -> Column:
    """A row's place in the order, to be put in a cursor."""
    return F.struct(*[c.alias(f"k{i}") for i, (c, _) in enumerate(keys)])


def at_key(keys: Sequence[tuple[Column, bool]], values: Sequence[object]) -> Column:
    same = F.lit(True)
    for (c, _), v in zip(keys, values, strict=True):
        same = same & c.eqNullSafe(F.lit(v))
    return same


def behind(keys: Sequence[tuple[Column, bool]], values: Sequence[object]) -> Column:
    """Rows that come after the one with these values in the order of the keys; nulls are last."""
    out, same = F.lit(False), F.lit(True)
    for (c, down), v in zip(keys, values, strict=True):
        if v is not None:
            out = out | (same & F.coalesce((c < F.lit(v)) if down else (c > F.lit(v)), F.lit(True)))
        same = same & c.eqNullSafe(F.lit(v))
    return out


def envelope(results: list[dict], truncated: bool, cursor: str | None, covered: dict, warnings: Sequence[str] = ()) -> dict:
    return {"results": results, "truncated": truncated, "next_cursor": cursor, "coverage": covered, "warnings": list(dict.fromkeys(warnings))}


def window_of(text: str, search_text: str, start: int, length: int, width: int) -> str:
    """The raw text around a span of its normal form, with marks where it is cut; the head if the two don't fit."""
    made, offsets = normal_map(text)
    a, b = (offsets[start], offsets[min(start + length, len(offsets) - 1)]) if made == search_text and start >= 0 else (0, 0)
    begin = max(0, a - max(0, width - (b - a)) // 2)
    return "…" * (begin > 0) + text[begin : begin + width] + "…" * (begin + width < len(text))


def hits(lake: Lake, messages: DataFrame, query: str, mode: str = "literal", max_scan: int | None = None, **filters) -> DataFrame:
    """Visible messages that match, with span_start and score.

    Where the terms have index tokens, only messages that hold them are read. Without any, a pool of more than max_scan
    messages is refused.
    """
    tokens = [t for term in terms_of(query, mode) for t in plan_term(term)]
    if tokens:
        messages = messages.join(postings.candidates(lake, tokens), "doc", "left_semi")
    elif max_scan is not None and messages.limit(max_scan + 1).count() > max_scan:
        raise QueryTooBroad("narrow the query by a source or dates")
    return archive.search(messages, query, mode, **filters)


def coverage(sources: DataFrame) -> dict:
    """First and last known time, and messages by source, of rows of source_id, messages, first and last."""
    rows = sources.select("source_id", "messages", "first", "last").collect()
    first, last = min((r["first"] for r in rows if r["first"]), default=None), max((r["last"] for r in rows if r["last"]), default=None)
    return {"first": first, "last": last, "sources": {r["source_id"]: r["messages"] for r in rows}}


def _coverage_of(lake: Lake, profile: dict | None) -> dict:
    """coverage() of what a profile sees, kept until messages or policy change.

    Merged from partials; an archive with changes that have none is scanned.
    """
    key, epoch = f"coverage {json.dumps(profile, sort_keys=True)}", lake.epoch()
    held = lake.opened.get(key)
    if held is None or held[0] != epoch:
        own = policy.profile_filters(profile) if profile else {}
        if partials.complete(lake):
            rows = partials.sources(lake, **own)
        else:
            times = [F.min("created_at").alias("first"), F.max("created_at").alias("last")]
            rows = lake.messages(**own).groupBy("source_id").agg(F.count(F.lit(1)).alias("messages"), *times)
        held = lake.opened[key] = (epoch, coverage(rows))
    return held[1]


def covered(lake: Lake, profile: dict | None) -> dict:
    """First and last known time of what a profile sees, whatever else is asked for."""
    found = _coverage_of(lake, profile)
    return {"first": found["first"], "last": found["last"]}


def by_source(lake: Lake, profile: dict | None) -> dict[str, int]:
    """Messages that a profile sees, by source."""
    return dict(_coverage_of(lake, profile)["sources"])


def _found(lake: Lake, query: str, mode: str, limit: int, branch: str, profile: dict | None, vectors: DataFrame | None, provider, max_scan: int | None, date_from: Column | None, date_to: Column | None, speaker: str | None, within: dict[str, str]) -> tuple[DataFrame, Column, list[str]]:
    """All that a search finds in a state of the archive, whether a hit's time is within the dates, and warnings."""
    own = policy.profile_filters(profile) if profile else {}
    pool = lake.messages(**own, **within)
    pool = pool.join(lake.paths().select("event_id").distinct(), "event_id", "left_semi") if branch == "selected" else pool
    every = hits(lake, pool, query, mode, max_scan, speaker=speaker).withColumn("kind", F.lit("exact"))
    warnings = []
    if branch == "selected" and (unknown := lake.path_unknown()):
        warnings.append(f"the path of {unknown} conversations is unknown")
    dated = F.lit(True)
    if date_from is not None:
        dated = dated & (F.col("created_at") >= date_from)
    if date_to is not None:
        dated = dated & (F.col("created_at") < date_to)
    dated = F.coalesce(dated, F.lit(False))
    if vectors is not None and provider is not None:
        every = fused(every.filter(dated), pool.filter(dated), vectors, provider.embed([query])[0], limit)
    return every, dated, warnings


def search_history(
    lake: Lake,
    query: str,
    mode: str = "literal",
    order: str = "chronological",
    limit: int = 20,
    cursor: str | None = None,
    branch: str = "all",
    profile: dict | None = None,
    redact: bool = False,
    width: int = 80,
    vectors: DataFrame | None = None,
    provider=None,
    max_scan: int | None = None,
    date_from: Column | None = None,
    date_to: Column | None = None,
    speaker: str | None = None,
    **within: str,
) -> dict:
    """A page of hits with snippets, citations and provenance; branch "selected" keeps to the selected paths.

    within: namespace, source and conversation. With vectors (an index) and a provider, relevance is the fused score of
    exact and semantic hits, and kind says which they are; the time orders use it between equal times. An unknown order or
    mode is the default. A cursor whose row is gone is an error. undated counts hits without a time: where dates are asked
    for, those that the dates leave out. All is read from one state of the archive.
    """
    lake = lake.snapshot()
    order, mode = order if order in ORDERS else "chronological", mode if mode in MODES else "literal"
    hybrid = vectors is not None and provider is not None
    every, dated, warnings = _found(lake, query, mode, limit, branch, profile, vectors, provider, max_scan, date_from, date_to, speaker, within)
    keys = keys_of(order, hybrid)
    values = decode(cursor, len(keys)) if cursor is not None else None
    rest = every.filter(dated)
    page = (rest if values is None else rest.filter(behind(keys, values))).withColumn("_key", key_values(keys))
    page = page.orderBy(*sorted_by(keys)).limit(limit + 1).collect()
    there = F.lit(True) if values is None else F.max(dated & at_key(keys, values))
    counted = every.agg(F.count_if(dated).alias("n"), F.count_if(F.col("created_at").isNull()).alias("undated"), there.alias("there")).first()
    if not counted["there"]:
        raise ValueError("the cursor's row is gone")
    more, page = len(page) > limit, page[:limit]
    first = terms_of(query, mode)[0]
    asked = lake.spark.createDataFrame([(r["revision_id"],) for r in page], "revision_id string")
    where = {r["revision_id"]: r for r in lake.provenance(asked).collect()} if page else {}
    results = [hit_row(r, len(first), width, redact, where.get(r["revision_id"])) for r in page]
    if any(x["redacted"] for x in results):
        warnings.append("credentials are masked")
    last = encode(list(page[-1]["_key"])) if more else None
    return envelope(results, more, last, covered(lake, profile), warnings) | {"total": counted["n"], "undated": counted["undated"]}


def all_pages(
    lake: Lake,
    query: str,
    mode: str = "literal",
    order: str = "chronological",
    limit: int = 20,
    branch: str = "all",
    profile: dict | None = None,
    vectors: DataFrame | None = None,
    provider=None,
    max_scan: int | None = None,
    date_from: Column | None = None,
    date_to: Column | None = None,
    speaker: str | None = None,
    **within: str,
) -> DataFrame:
    """event_id, revision_id, created_at, kind, score, place (from 0) and page (from 0) of all hits of a search.

    The pages are those that search_history() gives one after the other by its cursors, each of which costs a search; here
    the search runs once, and places are counted up by ranges of the order.
    """
    lake = lake.snapshot()
    order, mode = order if order in ORDERS else "chronological", mode if mode in MODES else "literal"
    every, dated, _ = _found(lake, query, mode, limit, branch, profile, vectors, provider, max_scan, date_from, date_to, speaker, within)
    keys = sorted_by(keys_of(order, vectors is not None and provider is not None))
    rows = every.filter(dated).repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = written(rows.select("event_id", "revision_id", "created_at", "kind", "score", F.spark_partition_id().alias("_part"), place.alias("_place")))
    sizes = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())
    starts = lake.spark.createDataFrame([(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)], "_part int, _start long")
    rows = rows.join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + F.col("_place"))
    return rows.withColumn("page", F.floor(F.col("place") / limit)).drop("_part", "_place", "_start")


#: Exact hits that take part in a fused ranking by their rank: five pages, and so many at most; others have exact only.
RANKED_PAGES, RANKED = 5, 200


def fused(found: DataFrame, pool: DataFrame, vectors: DataFrame, query: Sequence[float], limit: int) -> DataFrame:
    """Exact and semantic hits with kind, score (fused) and exact (the exact score)."""
    near = semantic.semantic_hits(vectors, query, limit, pool)
    top = found.orderBy(*sorted_by(keys_of("relevance"))).limit(min(RANKED_PAGES * limit, RANKED))
    ranked = top.select("revision_id", F.row_number().over(Window.orderBy(*sorted_by(keys_of("relevance")))).alias("rank"))
    both = semantic.hybrid(ranked, near).select("revision_id", F.col("kind").alias("found_as"), F.round("fused", 9).alias("fused"))
    exact = found.select("revision_id", "span_start", F.col("score").alias("exact"))
    rows = exact.join(both, "revision_id", "full")
    kind = F.when(F.col("found_as").isNull(), "exact").when((F.col("found_as") == "semantic") & F.col("exact").isNotNull(), "both").otherwise(F.col("found_as"))
    rows = rows.select("revision_id", "span_start", "exact", kind.alias("kind"), F.coalesce("fused", F.lit(0.0)).alias("score"))
    return pool.join(rows, "revision_id")


def hit_row(r: Row, length: int, width: int, redact: bool, where: Row | None) -> dict:
    text = r["text"] or ""
    safe = masked_text(text) if redact else text
    start = r["span_start"] if r["span_start"] is not None else -1
    return {
        "event_id": r["event_id"], "revision_id": r["revision_id"], "citation": ids.CITATION + r["revision_id"], "conversation": r["conversation"], "speaker": r["speaker"], "time": r["created_at"],
        "score": r["score"], "kind": r["kind"], "snippet": window_of(safe, r["search_text"] or "", start, length, width) if safe == text else window_of(safe, normal(safe), start, length, width),
        "redacted": safe != text, "node": where["node"] if where else None, "occurrences": [x.asDict() for x in where["occurrences"]] if where else [],
    }


def recent_events(lake: Lake, now: datetime, days: int = 7, limit: int = 20, cursor: str | None = None, profile: dict | None = None) -> dict:
    if not 0 <= days <= 3650:
        raise ValueError("0 to 3650 days")
    lake = lake.snapshot()
    seen = lake.messages(**(policy.profile_filters(profile) if profile else {}))
    after = None
    if cursor is not None:
        time, event = decode(cursor, 2)
        after = (F.lit(time).cast("timestamp"), F.lit(event))
    page = archive.recent(seen, now, days, limit + 1, after=after).collect()
    more, page = len(page) > limit, page[:limit]
    results = [{k: r[k] for k in ("event_id", "revision_id", "conversation", "speaker", "created_at", "text")} for r in page]
    return envelope(results, more, encode([page[-1]["created_at"], page[-1]["event_id"]]) if more else None, covered(lake, profile))


def get_event(lake: Lake, event: str, radius: int = 2, text_offset: int = 0, text_limit: int = 4000, profile: dict | None = None, redact: bool = False) -> dict:
    """One event: a page of its text, its visible versions, and its neighbours on the selected path.

    What isn't there and what policy hides give the same error.
    """
    lake, filters = lake.snapshot(), policy.profile_filters(profile) if profile else {}
    asked = lake.spark.createDataFrame([(event,)], "event_id string")
    own = lake.representative(asked, **filters).first()
    if own is None:
        raise LookupError("no such event")
    text = masked_text(own["text"] or "") if redact else own["text"] or ""
    versions = lake.messages(**filters).filter(F.col("event_id") == event).orderBy("recorded_at", "revision_id").select("revision_id", "version", "recorded_at").collect()
    near = context(lake, asked, radius, **filters).orderBy("position").collect()
    end = text_offset + text_limit
    return {
        "event_id": event, "revision_id": own["revision_id"], "citation": ids.CITATION + own["revision_id"], "speaker": own["speaker"], "time": own["created_at"], "text": text[text_offset:end],
        "next_offset": end if end < len(text) else None, "versions": [v.asDict() for v in versions], "context": [{"event_id": r["event_id"], "position": r["position"], "speaker": r["speaker"], "text": masked_text(r["text"] or "") if redact else r["text"]} for r in near if r["event_id"] != event],
    }


def context(lake: Lake, events: DataFrame, radius: int, **filters) -> DataFrame:
    """The visible messages at most radius positions from events on their selected paths, those included."""
    paths = lake.paths()
    at = paths.join(events.select("event_id").distinct(), "event_id", "left_semi").select("conversation", F.explode(F.sequence(F.col("position") - radius, F.col("position") + radius)).alias("position")).distinct()
    near = paths.join(at, ["conversation", "position"], "left_semi").filter("event_id is not null")
    return lake.representative(near, **filters).join(near.select("event_id", "position"), "event_id")


def fragments(found: DataFrame, paths: DataFrame, radius: int) -> DataFrame:
    """Hits (event_id, conversation, rank, kind) as fragments: conversation, island, low and high position, first rank, kind and events.

    Hits on a path whose windows touch are one fragment; each other hit is one of its own, with null positions. Fragments
    come by their conversation's first hit, then position.
    """
    rows = found.join(paths.select("conversation", "event_id", "position"), ["conversation", "event_id"], "left")
    on = archive.islands(rows.filter("position is not null"), radius)
    off = rows.filter("position is null").withColumn("island", F.concat(F.lit("-"), "event_id"))
    both = on.withColumn("island", F.col("island").cast("string")).unionByName(off)
    kinds = F.collect_set("kind")
    kind = F.when(F.array_contains(kinds, "both") | (F.size(kinds) > 1), "both").otherwise(F.element_at(kinds, 1))
    out = both.groupBy("conversation", "island").agg(F.min("position").alias("low"), F.max("position").alias("high"), F.min("rank").alias("rank"), kind.alias("kind"), F.sort_array(F.collect_set("event_id")).alias("events"))
    first = Window.partitionBy("conversation")
    return out.withColumn("first", F.min("rank").over(first))


def fitted(messages: list[dict], left: int) -> tuple[list[dict], int]:
    """What of a fragment fits: hits always, cut where the budget ends; other messages until the first that doesn't fit."""
    out, used = [], 0
    for m in messages:
        if m["is_hit"]:
            if (room := left - used) < 1:
                break
            shown = m["text"][:room]
            cut = len(shown) < len(m["text"])
            out.append(m | {"text": shown, "truncated": cut} | ({"text_offset": len(shown)} if cut else {}))
        elif used + len(m["text"]) > left:
            break
        else:
            shown = m["text"]
            out.append(m | {"truncated": False})
        used += len(shown)
    return out, used


def recall(lake: Lake, query: str, mode: str = "literal", max_snippets: int = 5, radius: int = 2, budget: int = 4000, max_limit: int = 100, profile: dict | None = None, redact: bool = False, within: dict | None = None, **filters) -> dict:
    """Fragments of conversations around the most relevant hits, within a budget of characters; hits of unknown time don't count.

    At most min(3 * max_snippets, max_limit) hits are looked at, so what is filled in here, in order, is bounded.
    """
    lake = lake.snapshot()
    own = policy.profile_filters(profile) if profile else {}
    seen = lake.messages(**own)
    pool = lake.messages(**own, **within) if within else seen
    top = archive.page(hits(lake, pool, query, mode, **filters), "relevance", min(3 * max_snippets, max_limit))
    rank = F.row_number().over(Window.orderBy(*archive.order_of("relevance")))
    ranked = top.withColumn("rank", rank).filter("created_at is not null").select("event_id", "conversation", "rank", F.lit("exact").alias("kind"))
    found = fragments(ranked, lake.paths(), radius).orderBy("first", F.col("low").asc_nulls_last(), "rank").collect()
    titles = {r["conversation"]: r["title"] for r in lake.titles(ranked).collect()}
    events = [e for f in found for e in f["events"]]
    near = context(lake, ranked, radius, **own).collect() if events else []
    alone = {r["event_id"]: r for r in lake.representative(ranked, **own).collect()} if events else {}
    snippets, used, dropped, masked = [], 0, 0, False
    for f in found:
        rows = [r for r in near if r["conversation"] == f["conversation"] and f["low"] is not None and f["low"] - radius <= r["position"] <= f["high"] + radius]
        rows = sorted(rows, key=lambda r: r["position"]) if f["low"] is not None else [alone[e] for e in f["events"] if e in alone]
        texts = [masked_text(r["text"] or "") if redact else r["text"] or "" for r in rows]
        messages = [{"event_id": r["event_id"], "revision_id": r["revision_id"], "speaker": r["speaker"], "time": r["created_at"], "text": t, "is_hit": r["event_id"] in f["events"]} for r, t in zip(rows, texts, strict=True)]
        need = sum(len(m["text"]) for m in messages if m["is_hit"])
        if len(snippets) >= max_snippets or not any(m["is_hit"] for m in messages) or need > budget - used:
            dropped += 1
            continue
        shown, size = fitted(messages, budget - used)
        if not any(m["is_hit"] for m in shown):
            dropped += 1
            continue
        masked |= any(t != (r["text"] or "") for r, t in zip(rows, texts, strict=True))
        times = [m["time"] for m in shown if m["time"]]
        snippets.append({"conversation": f["conversation"], "title": titles.get(f["conversation"], ""), "kind": f["kind"], "time_range": [min(times), max(times)] if times else [None, None], "messages": shown})
        used += size
    out = envelope(snippets, dropped > 0, None, covered(lake, profile), ["credentials are masked"] if masked else [])
    return out | {"budget": {"used": used, "of": budget, "dropped": dropped}}


def one_per_event(messages: DataFrame, current: DataFrame) -> DataFrame:
    """One row of each event: its current revision if that is among them, else the earliest, then the least id."""
    rows = messages.join(current.select(F.col("current_revision_id").alias("revision_id"), F.lit(True).alias("is_current")), "revision_id", "left")
    w = Window.partitionBy("event_id").orderBy(F.coalesce("is_current", F.lit(False)).desc(), F.col("created_at").asc_nulls_last(), "revision_id")
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth", "is_current")


def timeline(lake: Lake, zone: str, date_from: str | None = None, date_to: str | None = None, per_day: int = 20, profile: dict | None = None, chars: int = 80) -> DataFrame:
    """Per local day and conversation: counts, first and last time, and the owner's first line, masked; per_day at most a day.

    more says how many conversations of the day aren't shown.
    """
    lake = lake.snapshot()
    rows = lake.messages(**(policy.profile_filters(profile) if profile else {})).filter("created_at is not null")
    if date_from:
        rows = rows.filter(F.col("created_at") >= archive.day_bound(date_from, zone))
    if date_to:
        rows = rows.filter(F.col("created_at") < archive.day_bound(date_to, zone, end=True))
    one = one_per_event(rows, lake.current())
    days = archive.timeline(one, zone)
    total = F.count(F.lit(1)).over(Window.partitionBy("day"))
    top = archive.top_per_day(days.withColumn("of_day", total), per_day).withColumn("more", F.greatest(F.col("of_day") - per_day, F.lit(0))).drop("of_day")
    lines = one.select(F.col("event_id").alias("first_owner"), first_line(F.col("text"), chars).alias("line"))
    return top.join(lines, "first_owner", "left").join(lake.titles(days), "conversation", "left")


def first_line(text: Column, chars: int = 80) -> Column:
    return F.substring(F.element_at(F.split(mask_credentials(F.substring(text, 1, 400)), "\n"), 1), 1, chars)


def federated(sources: dict[str, DataFrame], limit: int) -> DataFrame:
    """Ranked lists (id, rank) merged in turn, the sources in their order."""
    out = None
    for i, (name, rows) in enumerate(sources.items()):
        one = rows.select(F.lit(name).alias("source"), F.lit(i).alias("turn"), F.col("id").cast("string").alias("id"), "rank").filter(F.col("rank") <= limit)
        out = one if out is None else out.unionByName(one)
    return out.orderBy("rank", "turn").limit(limit).drop("turn")


def resolve_citation(lake: Lake, cite: str, profile: dict | None = None) -> Row | None:
    """The visible revision that a citation names, or none."""
    rows = lake.messages(**(policy.profile_filters(profile) if profile else {}))
    return rows.filter(F.col("revision_id") == ids.cited_revision(F.lit(cite))).first()


def show_event(lake: Lake, event: str) -> DataFrame:
    """All revisions of an event with their policy, withdrawn ones too: for the archive's keeper."""
    return lake.table("revisions").filter(F.col("event_id") == event).join(lake.policy().withColumnRenamed("recorded_at", "policy_at"), "revision_id", "left").orderBy("recorded_at", "revision_id")


def brain_status(lake: Lake, profile: dict | None = None) -> dict:
    """Visible coverage, messages by source, the last import and whether any import was partial or failed."""
    lake = lake.snapshot()
    jobs = [j for j in lake.jobs() if j["kind"] == "import"]
    warnings = [f"an import is {s}" for s in ("partial", "failed") if any(j["status"] == s for j in jobs)]
    return {"coverage": covered(lake, profile), "sources": by_source(lake, profile), "last_import": max((j["at"] for j in jobs), default=None), "warnings": warnings}
