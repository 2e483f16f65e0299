"""Claims from conversations: segments for a language model, checks of what it proposes, similarity, review and relations.

Segments and checks run on Spark. Claims, their revisions and evidence are tables; a review only appends actions, and the
state of a claim is what its actions come to, so nothing is rewritten.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from chatlake.functions.text import bigram_jaccard, has_credentials, mask_credentials, normal, normal_map
from chatlake.operators import closure
from chatlake.operators.semantic import cosine

# Types and kinds of claims, reasons for which a proposal is rejected, limits.
MEMORY_TYPES = ("preference", "goal", "decision", "project_fact", "open_question")
ASSERTION_KINDS = ("self_report", "intention", "hypothesis", "quotation", "external_claim", "model_inference")
REASONS = ("bad_shape", "content_too_long", "invalid_memory_type", "invalid_assertion_kind", "no_evidence", "assistant_only_evidence", "span_mismatch", "unknown_revision", "context_only_evidence")
MAX_CONTENT, MAX_QUOTE = 300, 120
SAME, RELATED, MOST_PAIRS = 0.90, 0.45, 20
GAP_SECONDS, SEGMENT_CHARS, CARRIED, LONG_OWNER = 3600, 6000, 4, 8000
TOKENS_A_CHAR, OVERHEAD_TOKENS = 0.8, 800
# End of the fixed values.
VERSIONS = {"segmentation": "1", "prompt": "1", "schema": "1", "rule": "1"}


def default_since(now: datetime, days: int = 30) -> datetime:
    return now - timedelta(days=days)


def candidate_rows(messages: DataFrame, since: Column | None = None, until: Column | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Visible messages with a text in a window of time, on selected paths where these are given; owners' overlong ones go."""
    rows = messages.filter(F.length("text") > 0)
    if since is not None:
        rows = rows.filter(F.col("created_at") >= since)
    if until is not None:
        rows = rows.filter(F.col("created_at") < until)
    if paths is not None:
        rows = rows.join(paths.select("event_id").distinct(), "event_id", "left_semi")
    return rows.filter(~((F.col("speaker") == "owner") & (F.length("text") > LONG_OWNER)))


def segments(rows: DataFrame, chars: int = SEGMENT_CHARS, gap: int = GAP_SECONDS, carried: int = CARRIED) -> DataFrame:
    """conversation, segment (from 0), place, revision_id, speaker, created_at, text and role of the messages of segments.

    A segment ends before a gap of more than so many seconds or where the budget of characters would be passed; its last
    messages come again in the next one as context. Segments without a message of the owner as support are left out. Rows
    stream through their conversation's task in order, which holds one segment at a time. Credentials are masked.
    """
    schema = pa.schema([("conversation", pa.string()), ("segment", pa.int64()), ("place", pa.int64()), ("revision_id", pa.string()), ("speaker", pa.string()), ("created_at", pa.timestamp("us", "UTC")), ("text", pa.string()), ("role", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, held, size = None, 0, [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if any(m["role"] == "support" and m["speaker"] == "owner" for m in held):
                yield pa.RecordBatch.from_pylist([m | {"conversation": at, "segment": number, "place": i} for i, m in enumerate(held)], schema=schema)
                number += 1

        for batch in batches:
            for m in batch.to_pylist():
                if m["conversation"] != at:
                    yield from closed()
                    at, number, held, size = m["conversation"], 0, [], 0
                m |= {"role": "support"}
                for ends in (lambda m=m: seconds(m) - seconds(held[-1]) > gap, lambda m=m: size + len(m["text"]) > chars):
                    if held and ends():
                        yield from closed()
                        held = [x | {"role": "context"} for x in held[-carried:]] if carried else []
                        size = sum(len(x["text"]) for x in held)
                if all(x["revision_id"] != m["revision_id"] for x in held):
                    held.append(m)
                    size += len(m["text"])
        yield from closed()

    seconds = lambda m: m["created_at"].timestamp() if m["created_at"] else 0.0
    own = rows.select(F.col("conversation").cast("string").alias("conversation"), "revision_id", "speaker", "created_at", mask_credentials("text").alias("text"))
    own = own.repartition("conversation").sortWithinPartitions("conversation", F.col("created_at").asc_nulls_first(), "revision_id")
    return own.mapInArrow(run, "conversation string, segment long, place long, revision_id string, speaker string, created_at timestamp, text string, role string")


def estimate(segmented: DataFrame) -> DataFrame:
    """segments, owner messages, chars and tokens that a run would send."""
    each = segmented.groupBy("conversation", "segment").agg(F.sum(F.length("text")).alias("chars"))
    size = each.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
    owners = segmented.filter("speaker = 'owner'").agg(F.countDistinct("revision_id").alias("owner_messages"))
    return size.crossJoin(owners).withColumn("tokens", F.round(F.col("chars") * TOKENS_A_CHAR + F.col("segments") * OVERHEAD_TOKENS).cast("long"))  # one row each


def prompts(segmented: DataFrame) -> DataFrame:
    """conversation, segment and the text that goes to the model: a line for each message."""
    line = F.concat(F.lit("[rev="), "revision_id", F.lit("] "), "speaker", F.lit("/"), "role", F.lit(": "), "text")
    return segmented.groupBy("conversation", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


def relation_prompt(pairs: Sequence[tuple[str, str]]) -> str:
    return "\n".join(f"{i}. NEW: {new}\n   OLD: {old}" for i, (new, old) in enumerate(pairs))


def model_json(content: str) -> dict:
    """The object in a model's answer, with or without a code fence around it; anything else is an error."""
    m = re.fullmatch(r"\s*```[A-Za-z]*\s*\n(.*?)\n?\s*```\s*", content, re.S)
    found = json.loads(m[1] if m else content)
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found


def proposals(spark: SparkSession, answers: DataFrame) -> DataFrame:
    """Proposed claims of answers (conversation, segment, answer: JSON text): content, memory_type, assertion_kind, evidence; ill-shaped ones have nulls."""
    item = "struct<content:string,memory_type:string,assertion_kind:string,evidence:array<struct<revision_id:string,quote:string>>>"
    inner = F.regexp_replace("answer", r"(?s)^\s*```[A-Za-z]*\s*|\s*```\s*$", "")
    claims = F.try_variant_get(F.try_parse_json(inner), "$.claims", "array<variant>")
    rows = answers.select("conversation", "segment", F.posexplode(claims).alias("nth", "v"))
    return rows.select("conversation", "segment", "nth", F.from_json(F.to_json("v"), item).alias("c")).select("conversation", "segment", "nth", "c.*")


def quote_span(text: str, quote: str) -> tuple[int, int] | None:
    """Where a quote stands in a text, both in normal form, as a span of the raw text."""
    made, offsets = normal_map(text)
    wanted = normal(quote.strip())
    at = made.find(wanted) if wanted else -1
    return None if at < 0 else (offsets[at], offsets[at + len(wanted) - 1] + 1)


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
def find_quotes(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    spans = [None if t is None or q is None else quote_span(t, q) for t, q in zip(text, quote, strict=True)]
    return pd.DataFrame({"start": pd.array([s and s[0] for s in spans], "Int32"), "end": pd.array([s and s[1] for s in spans], "Int32")})


def validated(proposed: DataFrame, segmented: DataFrame) -> DataFrame:
    """Each proposal with its checked evidence and reason (null: it stands).

    Evidence must quote a message of its segment word for word, the owner's, and one there as support; what doesn't is
    dropped, and a proposal with none left is rejected. asserted_at is the earliest time of its evidence.
    """
    key = ["conversation", "segment", "nth"]
    known = segmented.withColumn("best", F.row_number().over(Window.partitionBy("conversation", "segment", "revision_id").orderBy(F.col("role").desc()))).filter("best = 1")
    cited = proposed.select(*key, F.explode("evidence").alias("e")).select(*key, "e.revision_id", "e.quote").filter("trim(quote) <> ''")
    cited = cited.join(known.select("conversation", "segment", "revision_id", "speaker", "role", "text", "created_at"), ["conversation", "segment", "revision_id"])
    owner = (F.col("speaker") == "owner") & (F.col("role") == "support")
    cited = cited.withColumn("span", F.when(owner & (F.length("quote") <= MAX_QUOTE), find_quotes("text", "quote")))
    ok = F.col("span.start").isNotNull()
    entry = F.struct("revision_id", "span.start", "span.end", F.substring(F.col("text"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start")).alias("quote"))
    found = cited.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(ok, entry))).alias("checked"), F.max(owner).alias("had_owner"), F.max(F.col("speaker") != "owner").alias("had_other"), F.min(F.when(ok, F.col("created_at"))).alias("asserted_at"))
    rows = proposed.join(found, key, "left")
    text, none = F.col("content"), F.lit(False)
    reason = (
        F.when(text.isNull() | (F.trim(text) == ""), "bad_shape").when(F.length(text) > MAX_CONTENT, "content_too_long")
        .when(~F.coalesce(F.col("memory_type").isin(*MEMORY_TYPES), none), "invalid_memory_type").when(~F.coalesce(F.col("assertion_kind").isin(*ASSERTION_KINDS), none), "invalid_assertion_kind")
        .when(F.coalesce(F.size("evidence"), F.lit(0)) == 0, "no_evidence").when(~F.coalesce("had_owner", none), F.when(F.coalesce("had_other", none), "assistant_only_evidence").otherwise("no_evidence"))
        .when(F.size("checked") == 0, "span_mismatch")
    )
    return rows.select(*key, F.trim(text).alias("content"), "memory_type", "assertion_kind", "asserted_at", F.col("checked").alias("evidence"), reason.alias("reason"))


def rejections(checked: DataFrame) -> DataFrame:
    return checked.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def similarity(a: Column, b: Column, u: Column | None = None, v: Column | None = None) -> Column:
    """1 for equal normal forms, else the larger of bigram Jaccard and, where there are vectors, cosine."""
    near = bigram_jaccard(a, b) if u is None else F.greatest(bigram_jaccard(a, b), cosine(u, v))
    return F.when(a == b, 1.0).otherwise(near)


def similar_claims(new: DataFrame, old: DataFrame, least: float = RELATED) -> DataFrame:
    """new_id, old_id and similarity of claims (claim_id, memory_type, content, search) of one type that are similar by bigrams.

    Pairs meet in a bigram of each one's rare first ones: of n bigrams, similar sets share one among the n - ceil(least * n) + 1
    first in an order by frequency, so no pair is formed that shares only common ones.
    """
    grams = lambda df: df.select("claim_id", "memory_type", "search", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("search") - 1, F.lit(1))), lambda i: F.substring("search", i, F.lit(2))))).alias("gram"))
    both = grams(new.withColumn("side", F.lit(0))).select("gram").unionByName(grams(old).select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def prefix(df: DataFrame) -> DataFrame:
        own = grams(df).join(both, "gram")
        w = Window.partitionBy("claim_id")
        own = own.withColumns({"nth": F.row_number().over(w.orderBy("df", "gram")), "n": F.count(F.lit(1)).over(w)})
        return own.filter(F.col("nth") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select("claim_id", "memory_type", "gram")

    a, b = prefix(new).alias("a"), prefix(old).alias("b")
    pairs = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.memory_type") == F.col("b.memory_type")) & (F.col("a.claim_id") != F.col("b.claim_id")))
    pairs = pairs.select(F.col("a.claim_id").alias("new_id"), F.col("b.claim_id").alias("old_id")).distinct()
    texts = lambda df, side, name: df.select(F.col("claim_id").alias(f"{side}_id"), F.col("search").alias(name))
    pairs = pairs.join(texts(new, "new", "x"), "new_id").join(texts(old, "old", "y"), "old_id")  # each pair is compared once
    return pairs.select("new_id", "old_id", similarity(F.col("x"), F.col("y")).alias("similarity")).filter(F.col("similarity") >= least)


def merged(new: DataFrame, old: DataFrame) -> DataFrame:
    """claim_id of new claims and same_as: the first open claim of the type at SAME or more (by created_at, id), or null."""
    found = similar_claims(new, old, SAME).join(old.select(F.col("claim_id").alias("old_id"), "created_at"), "old_id")
    first = found.groupBy("new_id").agg(F.min(F.struct("created_at", "old_id")).alias("first"))
    return new.select("claim_id").join(first.select(F.col("new_id").alias("claim_id"), F.col("first.old_id").alias("same_as")), "claim_id", "left")


def relation_candidates(new: DataFrame, old: DataFrame) -> DataFrame:
    """The MOST_PAIRS most similar pairs below SAME, for the model to name their relation."""
    found = similar_claims(new, old, RELATED).filter(F.col("similarity") < SAME)
    return found.orderBy(F.col("similarity").desc(), "new_id", "old_id").limit(MOST_PAIRS)


def extraction_key(revisions: Sequence[str], provider: str, model: str, config: dict | None = None) -> str:
    """The same input, versions and model always have the same key, so a run isn't done twice."""
    return hashlib.sha256(json.dumps([sorted(revisions), VERSIONS, provider, model, config or {}], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def evidence_rows(claims: DataFrame, revisions: DataFrame) -> DataFrame:
    """claim_id, revision_id, start, end, quote and digest of claims' evidence whose spans lie in their revisions' texts."""
    each = claims.select("claim_id", F.explode("evidence").alias("e")).select("claim_id", "e.*").drop("quote")
    rows = each.join(revisions.select("revision_id", "text"), "revision_id").filter((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("text")))
    quote = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.select("claim_id", "revision_id", "start", "end", quote.alias("quote"), F.sha2(quote, 256).alias("digest"))


# Review: actions are rows of claim_id, seq, action, actor, at, content (of an edit), other (of a relation).
ACTIONS = {"approve": "approved", "reject": "rejected", "edit": "approved", "supersede": "superseded", "invalidate": "needs_review"}


def states(claims: DataFrame, actions: DataFrame, withdrawn: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """Claims with status and content by their last action (skip changes nothing; pending without one).

    An approved claim with evidence from a withdrawn revision needs review.
    """
    known = actions.filter(F.col("action").isin(*ACTIONS))
    last = known.groupBy("claim_id").agg(F.max_by("action", "seq").alias("action"), F.max_by("content", F.when(F.col("action") == "edit", F.col("seq"))).alias("edited"))
    status = F.coalesce(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("action")], F.lit("pending"))
    out = claims.join(last, "claim_id", "left").withColumns({"status": status, "content": F.coalesce("edited", "content")}).drop("action", "edited")
    if withdrawn is not None and evidence is not None:
        hit = evidence.join(withdrawn.select("revision_id").distinct(), "revision_id", "left_semi").select("claim_id", F.lit(True).alias("lost")).distinct()
        out = out.join(hit, "claim_id", "left").withColumn("status", F.when(F.col("lost") & (F.col("status") == "approved"), "needs_review").otherwise(F.col("status"))).drop("lost")
    return out


def pending_claims(reviewed: DataFrame, limit: int = 50) -> DataFrame:
    """The queue: pending ones first, then those that need review, oldest first."""
    rows = reviewed.filter("status in ('pending', 'needs_review')")
    return rows.orderBy((F.col("status") != "pending"), F.col("asserted_at").asc_nulls_first(), "claim_id").limit(limit)


def list_claims(reviewed: DataFrame, evidence: DataFrame, relations: DataFrame, status: str | None = None) -> DataFrame:
    """Claims with how much evidence they have and which claim supersedes them."""
    rows = reviewed if status is None else reviewed.filter(F.col("status") == status)
    counts = evidence.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    newer = relations.filter("relation = 'supersedes' and status = 'confirmed'").groupBy(F.col("old_id").alias("claim_id")).agg(F.min("new_id").alias("superseded_by"))
    return rows.join(counts, "claim_id", "left").join(newer, "claim_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0))).orderBy(F.col("asserted_at").asc_nulls_first(), "claim_id")


def decision_timeline(reviewed: DataFrame) -> DataFrame:
    return reviewed.filter("status = 'approved'").orderBy(F.col("asserted_at").asc_nulls_last(), "claim_id")


def explained(reviewed: DataFrame, evidence: DataFrame, relations: DataFrame, messages: DataFrame, claim_id: str) -> dict[str, DataFrame]:
    """One claim, its quotes from visible revisions, and its relations with both ends' wording."""
    one = F.col("claim_id") == claim_id
    words = lambda side: reviewed.select(F.col("claim_id").alias(f"{side}_id"), F.col("content").alias(f"{side}_content"))
    quotes = evidence.filter(one).join(messages.select("revision_id", "event_id", "created_at", "text"), "revision_id")
    quotes = quotes.select("revision_id", "event_id", "created_at", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("quote"))
    related = relations.filter((F.col("new_id") == claim_id) | (F.col("old_id") == claim_id))
    return {"claim": reviewed.filter(one), "evidence": quotes, "relations": related.join(words("new"), "new_id").join(words("old"), "old_id")}


def superseding(relations: DataFrame) -> DataFrame:
    """source and target of the confirmed relations by which a claim supersedes another."""
    rows = relations.filter("relation = 'supersedes' and status = 'confirmed'")
    return rows.select(F.col("new_id").alias("source"), F.col("old_id").alias("target"))


def leads_to(relations: DataFrame, start: str, goal: str) -> bool:
    """Whether confirmed supersedes relations lead from a claim to another."""
    goals = relations.sparkSession.createDataFrame([(start, goal)], "start string, goal string")
    found = closure.reached(superseding(relations), goals.select("start"), goals)
    return not found.filter((F.col("start") == start) & (F.col("node") == goal)).isEmpty()


def decide_all(relations: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A whole batch of decisions (new_id, old_id, decision) at once: the relations' new rows, and the decisions refused.

    Refused are supersedes decisions that would close a circle, with what is confirmed or with each other.
    """
    own = decisions.select("new_id", "old_id", "decision").distinct()
    proposed = own.filter("decision = 'supersedes'").select(F.col("new_id").alias("source"), F.col("old_id").alias("target"))
    bad = closure.on_circles(superseding(relations), proposed).select(F.col("source").alias("new_id"), F.col("target").alias("old_id"), F.lit("supersedes").alias("decision"))
    good = own.join(bad, ["new_id", "old_id", "decision"], "left_anti").filter("decision in ('supersedes', 'coexists', 'reject_new', 'dismiss')")
    status = F.when(F.col("decision").isin("supersedes", "coexists"), "confirmed").otherwise("dismissed")
    return good.select("new_id", "old_id", F.col("decision").alias("relation"), status.alias("status")), bad


def decide(relations: DataFrame, new_id: str, old_id: str, decision: str, seq: int, actor: str, at: datetime) -> tuple[dict, list[dict]]:
    """The relation's new row and the actions that a decision appends: supersedes, coexists, reject_new or dismiss."""
    act = lambda claim, what, i: {"claim_id": claim, "seq": seq + i, "action": what, "actor": actor, "at": at, "content": None, "other": old_id}
    row = {"new_id": new_id, "old_id": old_id, "relation": decision, "status": "confirmed"}
    if decision == "supersedes":
        if leads_to(relations, old_id, new_id):
            raise ValueError("claims would supersede each other in a circle")
        return row, [act(new_id, "approve", 0), act(old_id, "supersede", 1)]
    if decision == "coexists":
        return row, []
    if decision in ("reject_new", "dismiss"):
        return row | {"status": "dismissed"}, [act(new_id, "reject", 0)] if decision == "reject_new" else []
    raise ValueError(f"unknown decision {decision!r}")


def resolve_claim(claims: DataFrame, name: str) -> str:
    """The id that a name is, or that alone begins with it."""
    found = [r["claim_id"] for r in claims.filter(F.col("claim_id").startswith(name)).select("claim_id").orderBy(F.col("claim_id") != name).limit(2).collect()]
    if name in found or len(found) == 1:
        return found[0]
    raise LookupError("no such claim" if not found else "several claims begin so")


def profile_section(reviewed: DataFrame) -> str:
    """Approved claims as Markdown, by type; as many lines as a person has approved."""
    rows = decision_timeline(reviewed).select("memory_type", "content").collect()
    return "\n\n".join(f"## {t}\n" + "\n".join(f"- {r['content']}" for r in rows if r["memory_type"] == t) for t in MEMORY_TYPES if any(r["memory_type"] == t for r in rows))


def with_section(text: str, section: str, begin: str = "<!-- claims -->", end: str = "<!-- /claims -->") -> str:
    """A document whose part between two marks is the section; marks are added at its end if they aren't there."""
    block = f"{begin}\n{section}\n{end}"
    if begin in text and end in text[text.index(begin) :]:
        at = text.index(begin)
        return text[:at] + block + text[text.index(end, at) + len(end) :]
    return f"{text.rstrip()}\n\n{block}\n" if text.strip() else f"{block}\n"


def run_extraction(rows: DataFrame, complete: Callable[[str], str], done: set[str], provider: str, model: str) -> tuple[str, DataFrame | None]:
    """The key of a run over segments (as written) and its checked proposals; none if a run with that key is done already.

    complete, a client of a model, is called on the driver, one segment at a time.
    """
    spark = rows.sparkSession
    digest = [r[0] for r in rows.groupBy(F.pmod(F.xxhash64("revision_id"), F.lit(64)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("revision_id")), ","), 256).alias("d")).select(F.concat_ws(":", "b", "d")).collect()]
    key = extraction_key(digest, provider, model)
    if key in done:
        return key, None
    answers = [(r["conversation"], r["segment"], complete(r["prompt"])) for r in prompts(rows).orderBy("conversation", "segment").toLocalIterator()]
    return key, validated(proposals(spark, spark.createDataFrame(answers, "conversation string, segment long, answer string")), rows)


def without_credentials(rows: DataFrame) -> DataFrame:
    return rows.filter(~has_credentials(F.col("text")))
