"""A stored vector index of chunks: kept up to date in batches that each are a commit, so a run that stops goes on where it was.

Tables: vectors (revision_id, digest, chunk, start, end, list, embedding), gone (revision_id, digest, upto: rows of changes up
to that number don't count any more), centroids (list, center) and packed (the int8 form). What an index was made with (model,
dimension, chunk sizes) stands in each of its changes; another provider needs a new index.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators import ivf, semantic
from chatlake.operators.commits import Log

SCHEMAS = {
    "vectors": "revision_id string, digest string, chunk int, start long, end long, list int, embedding array<double>, made long",
    "gone": "revision_id string, digest string, upto long",
    "centroids": "list int, center array<double>",
    "packed": "revision_id string, digest string, chunk int, int8 array<tinyint>, scale double, made long",
}
#: Revisions that one commit embeds, about; commits of a run at most, as each looks through what is indexed. With more
#: revisions the commits are larger, so that a run's work grows with the revisions, not with their square.
BATCH, COMMITS = 100_000, 16
CHUNK = ["revision_id", "chunk"]


class VectorIndex(Log):
    def table(self, name: str) -> DataFrame:
        paths = self.folders(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def meta(self) -> dict | None:
        """What the index was made with, and when it was last brought up to date as a whole."""
        made = [j["meta"] for j in self.jobs() if "meta" in j and j["status"] == "complete"]
        if not made:
            return None
        done = [j["at"] for j in self.jobs() if j["kind"] == "up to date"]
        packed = "int8" if self.parts("packed") else "none"
        return made[-1] | {"built_at": done[-1] if done else None, "packing": packed}

    def alive(self, name: str) -> DataFrame:
        """The rows of vectors or packed that count."""
        rows = self.table(name)
        if not self.parts("gone"):
            return rows
        gone = self.table("gone").groupBy("revision_id", "digest").agg(F.max("upto").alias("upto"))
        rows = rows.join(gone, ["revision_id", "digest"], "left")
        return rows.filter(F.col("upto").isNull() | (F.col("made") > F.col("upto"))).drop("upto")

    def state(self) -> DataFrame:
        """revision_id and digest of what is indexed."""
        return self.alive("vectors").select("revision_id", "digest").distinct()

    def centers(self) -> np.ndarray | None:
        """The lists' centroids: at most ivf.LISTS rows."""
        rows = sorted(self.table("centroids").collect())
        return np.array([r["center"] for r in rows]) if rows else None


def wanted(provider, size: int, overlap: int) -> dict:
    return {"model": provider.model_id, "dimension": provider.dimension, "chunk": size, "overlap": overlap}


def _mark(rows: DataFrame, seq: int) -> DataFrame:
    return rows.select("revision_id", "digest", F.lit(seq).cast("long").alias("upto"))


def update(index: VectorIndex, revisions: DataFrame, provider, now: datetime, size: int = 600, overlap: int = 100, batch: int = BATCH) -> dict[str, int]:
    """Brings the index up to date with revisions (revision_id, text): what is stale goes, what is lacking is embedded.

    Batches are slices by the hash of the revision, of batch revisions or so, or more where that would make over COMMITS of
    them; each is committed by itself, so what a broken run has done stays done.
    """
    meta = wanted(provider, size, overlap)
    held = index.snapshot().meta()
    if held is not None and any(held[k] != v for k, v in meta.items()):
        raise ValueError("the index was made with another model or other chunks")
    eligible = revisions.select("revision_id", "text", F.sha2("text", 256).alias("digest"))
    keys = ["revision_id", "digest"]

    def drop_stale(base: VectorIndex, job: dict) -> tuple[dict, dict[str, DataFrame]] | None:
        stale = base.state().join(eligible, keys, "left_anti")
        return None if stale.isEmpty() else ({"meta": meta}, {"gone": _mark(stale, job["seq"] - 1)})

    index.change(drop_stale, "stale", now)
    lacking = lambda base: eligible.join(base.state(), keys, "left_anti")
    n = lacking(index.snapshot()).count()
    slices = min(COMMITS, max(1, -(-n // batch)))
    for i in range(slices if n else 0):

        def embed(base: VectorIndex, job: dict, i: int = i) -> tuple[dict, dict[str, DataFrame]] | None:
            own = F.pmod(F.xxhash64("revision_id"), F.lit(slices)) == i
            rows = eligible.filter(own).join(base.state().filter(own), keys, "left_anti")
            chunks = semantic.embedded(semantic.chunked(rows, size, overlap), provider).join(rows.select(*keys), "revision_id")
            return {"meta": meta}, {"vectors": listed(chunks, base.centers()).select(*_columns("vectors", job["seq"]))}

        index.change(embed, "embed", now)
    if index.snapshot().parts("packed"):
        convert(index, "int8", now)
    index.change(lambda base, job: ({"meta": meta}, {}), "up to date", now)
    return {"embedded": n, "batches": slices if n else 0}


def _columns(name: str, seq: int) -> list:
    names = [f.strip().split(" ")[0] for f in SCHEMAS[name].split(",")]
    return [F.lit(seq).cast("long").alias("made") if c == "made" else F.col(c) for c in names]


def listed(chunks: DataFrame, centers: np.ndarray | None) -> DataFrame:
    """Chunks with the list of their vectors; null without centroids."""
    if centers is None:
        return chunks.withColumn("list", F.lit(None).cast("int"))
    whole = chunks.withColumn("_row", F.struct(*[c for c in chunks.columns if c != "embedding"]))
    out = ivf.dealt(whole, centers, "_row")
    return out.select("list", "_row.*", "embedding")


def make_lists(index: VectorIndex, lists: int, now: datetime) -> dict:
    """Trains centroids on a sample and deals all vectors to them; files are sorted by list. Replaces the vectors' files."""

    def build(base: VectorIndex, job: dict) -> tuple[dict, dict[str, DataFrame]]:
        rows = base.alive("vectors")
        named = rows.withColumn("_key", F.struct(*CHUNK))
        centers = ivf.centroids(named, lists, "_key")
        new = listed(rows.drop("list", "made"), centers).select(*_columns("vectors", job["seq"]))
        table = base.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], SCHEMAS["centroids"])
        old = {t: [j["attempt"] for j, _ in base.parts(t)] for t in ("vectors", "centroids", "gone")}
        gone = {t: a for t, a in old.items() if a and t != "gone"}
        return {"drops": gone}, {"vectors": new.sort("list"), "centroids": table}

    return index.change(build, "lists", now)


def convert(index: VectorIndex, packing: str, now: datetime) -> dict:
    """Gives the index its int8 form beside the vectors (or takes it away), in one commit, without embedding anything again."""
    if packing not in ("int8", "none"):
        raise ValueError(f"unknown packing {packing!r}")

    def build(base: VectorIndex, job: dict) -> tuple[dict, dict[str, DataFrame]]:
        drops = {"packed": [j["attempt"] for j, _ in base.parts("packed")]}
        if packing == "none":
            return {"drops": drops}, {}
        rows = semantic.packed_vectors(base.alive("vectors"))
        return {"drops": drops}, {"packed": rows.select(*_columns("packed", job["seq"]))}

    return index.change(build, "convert", now)


def purge(index: VectorIndex, revisions: DataFrame, now: datetime) -> dict | None:
    """Takes revisions (revision_id) out of the index: for what was withdrawn."""

    def build(base: VectorIndex, job: dict) -> tuple[dict, dict[str, DataFrame]] | None:
        rows = base.state().join(revisions.select("revision_id").distinct(), "revision_id", "left_semi")
        return None if rows.isEmpty() else ({}, {"gone": _mark(rows, job["seq"] - 1)})

    return index.change(build, "purge", now)


def nearest_chunks(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, revision_id, chunk, start, end, distance and rank of each query's k nearest chunks.

    queries: query_id and embedding. With probes, only that many lists a query are looked into; without, or without lists, all.
    """
    state = index.snapshot()
    rows = state.alive("vectors").withColumn("_key", F.struct("revision_id", "chunk", "start", "end"))
    centers = state.centers()
    if probes is None or centers is None:
        found = ivf.exact(rows, queries, k, "_key")
    else:
        found = ivf.search(ivf.Index(ivf.blocks(rows.select("list", "_key", "embedding"), "_key"), centers, "_key", "embedding"), queries, k, probes)
    return found.select("query_id", "_key.*", "distance", "rank")


def search(index: VectorIndex, texts: Sequence[str], provider, k: int, probes: int | None = None, floor: float = semantic.NOISE_FLOOR) -> DataFrame:
    """query_id (a text's place), revision_id and the rest of the best chunk of each of the k nearest revisions."""
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(provider.embed(list(texts)))]
    queries = index.spark.createDataFrame(vectors, "query_id int, embedding array<double>")
    found = nearest_chunks(index, queries, 5 * k, probes).filter(semantic.cosine_of(F.col("distance")) >= floor)
    best = found.groupBy("query_id", "revision_id").agg(F.min(F.struct("distance", "start", "end", "chunk")).alias("b"))
    return ivf.first(best.select("query_id", "revision_id", "b.*"), k, "revision_id")
