"""Claims as stored tables: what models propose is recorded once a run, reviews append actions, and reads give the state.

Tables: claims (claim_id, memory_type, assertion_kind, content, search, asserted_at, created_at, run), evidence (claim_id,
revision_id, start, end, quote, digest), actions, relations (new_id, old_id, relation, status) with the last row of a pair
counting, and runs (run, at). Each change is one commit; of two runs at the same time the second is matched against what the
first has left, so the same claim isn't recorded twice.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions.text import normalize
from chatlake.operators import facts
from chatlake.operators.commits import Log
from chatlake.operators.scratch import written

SCHEMAS = {
    "claims": "claim_id string, memory_type string, assertion_kind string, content string, search string, asserted_at timestamp, created_at timestamp, run string",
    "evidence": "claim_id string, revision_id string, start int, end int, quote string, digest string",
    "actions": "claim_id string, seq long, action string, actor string, at timestamp, content string, other string",
    "relations": "new_id string, old_id string, relation string, status string, seq long",
    "runs": "run string, at timestamp",
}
# What a model may call a relation.
RELATIONS = ("same", "refines", "supersedes", "contradicts", "coexists", "unrelated")
# End of the fixed values.


class ClaimStore(Log):
    def table(self, name: str) -> DataFrame:
        paths = self.folders(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def rows(self, name: str, df: DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return df.select(*[F.col(f.name).cast(f.dataType) for f in fields])

    def relations(self) -> DataFrame:
        """The last row of each pair."""
        last = F.max_by(F.struct("relation", "status"), "seq").alias("s")
        return self.table("relations").groupBy("new_id", "old_id").agg(last).select("new_id", "old_id", "s.*")

    def state(self, withdrawn: DataFrame | None = None) -> DataFrame:
        """Claims with status and content by their last action; withdrawn: revision_id of evidence that is gone."""
        return facts.states(self.table("claims"), self.table("actions"), withdrawn, self.table("evidence") if withdrawn is not None else None)


def record(store: ClaimStore, run: str, checked: DataFrame, revisions: DataFrame, now: datetime) -> dict | None:
    """Records the proposals that stand (of facts.validated()) with their evidence; None if the run is recorded already.

    A proposal that says what an open claim of its type says already adds its evidence to that claim. The most similar other
    pairs are recorded as relations to be named. Of equal proposals of a run one is recorded.
    """

    def build(base: ClaimStore, job: dict) -> tuple[dict, dict[str, DataFrame]] | None:
        if not base.table("runs").filter(F.col("run") == run).isEmpty():
            return None
        good = checked.filter("reason is null").withColumn("search", normalize("content"))
        name = F.sha2(F.concat_ws("|", F.lit(run), "memory_type", "search"), 256)
        good = good.withColumn("claim_id", F.concat(F.lit("claim-"), F.substring(name, 1, 20)))
        one = F.min(F.struct("asserted_at", "content", "assertion_kind", "search", "memory_type"))
        new = good.groupBy("claim_id").agg(one.alias("c"), F.flatten(F.collect_list("evidence")).alias("evidence"))
        new = written(new.select("claim_id", "c.*", "evidence").withColumns({"created_at": F.lit(now), "run": F.lit(run)}))
        open_ = base.state().filter("status in ('pending', 'approved', 'needs_review')").withColumn("search", normalize("content"))
        open_ = written(open_.select("claim_id", "memory_type", "content", "search", "created_at"))
        same = written(facts.merged(new.select("claim_id", "memory_type", "content", "search", "created_at"), open_))
        fresh = new.join(same.filter("same_as is null").select("claim_id"), "claim_id", "left_semi")
        proof = new.join(same, "claim_id").withColumn("claim_id", F.coalesce("same_as", "claim_id"))
        proof = facts.evidence_rows(proof.select("claim_id", "evidence"), revisions)
        proof = proof.distinct().join(base.table("evidence"), ["claim_id", "revision_id", "start", "end"], "left_anti")
        pairs = facts.relation_candidates(fresh.select("claim_id", "memory_type", "content", "search", "created_at"), open_)
        pairs = pairs.select("new_id", "old_id", F.lit(None).cast("string").alias("relation"), F.lit("suggested").alias("status"), F.lit(job["seq"]).alias("seq"))
        done = base.spark.createDataFrame([(run, now)], SCHEMAS["runs"])
        tables = {"claims": fresh, "evidence": proof, "relations": pairs, "runs": done}
        return {}, {t: base.rows(t, df) for t, df in tables.items()}

    return store.change(build, "record", now, run=run)


def relation_answers(answers: DataFrame, pairs: DataFrame) -> DataFrame:
    """new_id, old_id and relation of a model's answers (run, answer: JSON text) about pairs (run, index, new_id, old_id).

    Entries without a number or with an unknown relation say nothing; of several about a pair the first counts.
    """
    inner = F.regexp_replace("answer", r"(?s)^\s*```[A-Za-z]*\s*|\s*```\s*$", "")
    items = F.try_variant_get(F.try_parse_json(inner), "$.relations", "array<variant>")
    rows = answers.select("run", F.posexplode(items).alias("nth", "v"))
    get = lambda key, kind: F.try_variant_get("v", f"$.{key}", kind)
    rows = rows.select("run", "nth", get("index", "int").alias("index"), get("relation_type", "string").alias("relation"))
    rows = rows.filter(F.col("relation").isin(*RELATIONS)).join(pairs, ["run", "index"])
    return rows.groupBy("new_id", "old_id").agg(F.min_by("relation", "nth").alias("relation"))


def name_relations(store: ClaimStore, named: DataFrame, now: datetime) -> dict:
    """Gives suggested relations the names of a model's answers; ones that are decided already keep what was decided."""

    def build(base: ClaimStore, job: dict) -> tuple[dict, dict[str, DataFrame]]:
        open_ = base.relations().filter("status = 'suggested'").select("new_id", "old_id")
        rows = named.join(open_, ["new_id", "old_id"]).withColumns({"status": F.lit("suggested"), "seq": F.lit(job["seq"])})
        return {}, {"relations": base.rows("relations", rows)}

    return store.change(build, "name", now)


def act(store: ClaimStore, claim: str, action: str, actor: str, now: datetime, content: str | None = None) -> dict:
    """Appends an action of a review: approve, reject, edit (with content), skip or invalidate."""
    if action not in (*facts.ACTIONS, "skip") or (action == "edit") != (content is not None):
        raise ValueError(f"no such action: {action}")

    def build(base: ClaimStore, job: dict) -> tuple[dict, dict[str, DataFrame]]:
        if base.table("claims").filter(F.col("claim_id") == claim).isEmpty():
            raise LookupError("no such claim")
        return {}, {"actions": base.spark.createDataFrame([(claim, job["seq"] * 10, action, actor, now, content, None)], SCHEMAS["actions"])}

    return store.change(build, "review", now)


def decide(store: ClaimStore, decisions: DataFrame, actor: str, now: datetime) -> DataFrame:
    """Takes a batch of decisions (new_id, old_id, decision) and returns those refused; see facts.decide_all().

    supersedes approves the new claim and marks the old one; reject_new rejects the new one.
    """
    refused: list[DataFrame] = []

    def build(base: ClaimStore, job: dict) -> tuple[dict, dict[str, DataFrame]]:
        rows, bad = facts.decide_all(base.relations(), decisions)
        rows, refused[:] = written(rows), [bad]
        about = lambda kind, claim, action, at: rows.filter(F.col("relation") == kind).select(F.col(claim).alias("claim_id"), F.lit(job["seq"] * 10 + at).alias("seq"), F.lit(action).alias("action"), F.lit(actor).alias("actor"), F.lit(now).alias("at"), F.lit(None).cast("string").alias("content"), F.col("old_id").alias("other"))
        done = about("supersedes", "new_id", "approve", 0).unionByName(about("supersedes", "old_id", "supersede", 1)).unionByName(about("reject_new", "new_id", "reject", 0))
        return {}, {"relations": base.rows("relations", rows.withColumn("seq", F.lit(job["seq"]))), "actions": base.rows("actions", done)}

    store.change(build, "decide", now)
    return refused[0]
