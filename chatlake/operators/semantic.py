"""Vectors: exact nearest neighbours, a coarse int8 pass with exact ranks, and fusion of ranked lists."""

from __future__ import annotations

import collections
import functools
import hashlib
import itertools
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from chatlake.functions.text import chunk_spans


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest by distance, then key, with rank from 1."""
    q = F.array(*map(F.lit, query)).cast("array<double>")
    found = vectors.withColumn("distance", distance(F.col(vector).cast("array<double>"), q)).orderBy("distance", key).limit(k)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))


def quantized(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, float]:
    """Vectors as int8 (column int8) with one scale for the whole table: 127 over its largest component."""
    top = vectors.agg(F.max(F.array_max(F.transform(vector, F.abs)))).first()[0] or 1.0
    scale = 127.0 / top
    pack = lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.bround(x.cast("double") * scale))).cast("tinyint")
    return vectors.withColumn("int8", F.transform(vector, pack)), scale


def fused(lists: Sequence[DataFrame], key: str, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists with key and rank: score is the sum of 1 / (constant + rank)."""
    every = lists[0].select(key, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select(key, "rank"))
    found = every.groupBy(key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("lists"))
    return found.withColumn("fused_rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), key)))


#: Groups of words that mean the same, the first standing for all; a provider can be given others.
GROUPS = (("求职", "找工作"), ("ship", "boat", "vessel"), ("灯塔", "航标"))
DIMENSION, PROBES, NOISE_FLOOR, CONSTANT = 256, 3, 0.3, 60
_WORDS, _RUNS = re.compile(r"[a-zA-Z0-9]+"), re.compile(r"[一-鿿]+")


def word_tokens(text: str) -> list[str]:
    """Latin words in lower case and pairs of Chinese characters, marked by kind."""
    runs = [p for run in _RUNS.findall(text) for p in ([run] if len(run) == 1 else map("".join, itertools.pairwise(run)))]
    return [f"w:{w.lower()}" for w in _WORDS.findall(text)] + [f"c:{p}" for p in runs]


def standing_tokens(text: str, groups: Sequence[Sequence[str]] = GROUPS) -> list[str]:
    """Tokens of the word that stands for each group with a member in the text; Latin members match in any case."""
    low, out = text.lower(), []
    for group in groups:
        if any(v in text or (v.isascii() and v.lower() in low) for v in group):
            out += [f"s:{group[0]}", *word_tokens(group[0])]
    return out


def weighted_tokens(text: str, groups: Sequence[Sequence[str]] = GROUPS) -> collections.Counter[str]:
    weights = collections.Counter(word_tokens(text))
    for t in standing_tokens(text, groups):
        weights[t] += 2
    return weights


@functools.lru_cache(100_000)
def _places(token: str, dimension: int, probes: int) -> list[tuple[int, float]]:
    digests = (hashlib.sha1(f"{i}:{token}".encode()).digest() for i in range(probes))
    return [(int.from_bytes(d[:4], "big") % dimension, -1.0 if d[4] % 2 else 1.0) for d in digests]


def hash_vector(text: str, dimension: int = DIMENSION, probes: int = PROBES, groups: Sequence[Sequence[str]] = GROUPS) -> list[float]:
    """A unit vector of signed hashed tokens (none: zeros): a stand-in for a model that needs no download."""
    out = np.zeros(dimension)
    for token, weight in weighted_tokens(text, groups).items():
        for at, sign in _places(token, dimension, probes):
            out[at] += sign * weight
    size = np.sqrt((out * out).sum())
    return (out / size if size else out).tolist()


def hash_places(text: str, dimension: int = DIMENSION, probes: int = PROBES, groups: Sequence[Sequence[str]] = GROUPS) -> list[int]:
    """The components that a text's tokens are added to, in order, those that come to 0 included."""
    return sorted({at for token in weighted_tokens(text, groups) for at, _ in _places(token, dimension, probes)})


@F.pandas_udf(ArrayType(IntegerType()))
def places(text: pd.Series) -> pd.Series:
    """hash_places() of each text; a null one has none."""
    return pd.Series([hash_places(t) for t in text.fillna("")])


class HashEmbedding:
    """The interface of an embedding provider: model_id, dimension and embed(texts)."""

    model_id = "hash-embedding-test"

    def __init__(self, dimension: int = DIMENSION, probes: int = PROBES, groups: Sequence[Sequence[str]] = GROUPS):
        if dimension < 16:
            raise ValueError("a dimension of 16 at least")
        self.dimension, self.probes, self.groups = dimension, probes, groups

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [hash_vector(t, self.dimension, self.probes, self.groups) for t in texts]


def embedded(rows: DataFrame, provider=None, text: str = "text", out: str = "embedding") -> DataFrame:
    """rows with the vectors of their texts, batch by batch, by any provider that can be pickled."""
    provider = provider or HashEmbedding()

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(provider.embed(texts.fillna("").tolist()))

    return rows.withColumn(out, vectors(text))


def chunked(revisions: DataFrame, size: int = 600, overlap: int = 100) -> DataFrame:
    """revision_id, chunk (from 0), start, end and text of the chunks of revisions."""
    spans = revisions.select("revision_id", "text", F.posexplode(chunk_spans(F.col("text"), size, overlap)).alias("chunk", "s"))
    return spans.select("revision_id", "chunk", "s.start", "s.end", F.substring(F.col("text"), (F.col("s.start") + 1).cast("int"), (F.col("s.end") - F.col("s.start")).cast("int")).alias("text"))


def pending(eligible: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an index lacks and what it must drop: (to embed, stale), by revision_id and revision content (digest).

    state and eligible have revision_id and digest; a changed digest is both.
    """
    lacking = eligible.join(state, ["revision_id", "digest"], "left_anti").select("revision_id")
    stale = state.join(eligible, ["revision_id", "digest"], "left_anti").select("revision_id")
    return lacking, stale


def reindexed(vectors: DataFrame, revisions: DataFrame, provider=None, size: int = 600, overlap: int = 100) -> DataFrame:
    """The vectors of an index brought up to date: stale ones dropped, those of new and changed revisions added.

    vectors: revision_id, digest, chunk, start, end, embedding. Only what is new is embedded.
    """
    eligible = revisions.select("revision_id", F.sha2("text", 256).alias("digest"))
    state = vectors.select("revision_id", "digest").distinct()
    lacking, stale = pending(eligible, state)
    new = chunked(revisions.join(lacking, "revision_id", "left_semi"), size, overlap)
    new = embedded(new, provider).join(eligible, "revision_id").select("revision_id", "digest", "chunk", "start", "end", "embedding")
    return vectors.join(stale, "revision_id", "left_anti").select(*new.columns).unionByName(new)


def index_sizes(vectors: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """chunks, revisions, components, and how many eligible revisions the index lacks."""
    out = vectors.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("revision_id").alias("revisions"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)).cast("long").alias("components"))
    if eligible is None:
        return out
    missing = eligible.join(vectors.select("revision_id").distinct(), "revision_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return out.crossJoin(missing)  # one row each


def packed_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors with int8 and scale columns, to be stored once; nearest_packed reads them as they are."""
    packed, scale = quantized(vectors, vector)
    return packed.withColumn("scale", F.lit(scale))


def packed_bits(vector: Column) -> Column:
    """Sign bits as longs, 64 components each, lowest first; the dimension must be a multiple of 64."""
    bit = lambda i, j: F.when(F.get(vector, i * 64 + j) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))
    word = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, j: s.bitwiseOR(bit(i, j)))
    return F.transform(F.sequence(F.lit(0), (F.size(vector) / 64 - 1).cast("int")), word)


def bit_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def nearest_packed(packed: DataFrame, query: Sequence[float], k: int, oversample: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k * oversample nearest by stored int8 vectors, and of these the k nearest by exact distance, with rank.

    The coarse pass reads int8 and scale only; float vectors are read for its few results. Both distances are squared sums
    over the components; the coarse one in whole numbers.
    """
    q = F.transform(F.array(*map(F.lit, query)), lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.bround(x * F.col("scale")))).cast("int"))
    far = F.aggregate(F.zip_with("int8", q, lambda x, y: (x - y) * (x - y)), F.lit(0), lambda s, x: s + x)
    coarse = packed.select(key, far.alias("coarse")).orderBy("coarse", key).limit(k * oversample)
    return nearest(packed.select(key, vector).join(F.broadcast(coarse.select(key)), key, "left_semi"), query, k, key, vector)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, distance and rank of each query's k nearest by distance, then key; see ivf.exact()."""
    from chatlake.operators import ivf

    return ivf.exact(vectors.select(key, vector), queries.select("query_id", vector), k, key, vector)


def nearest_many_packed(packed: DataFrame, queries: DataFrame, k: int, oversample: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key and rank of each query's k nearest of the k * oversample nearest by int8 vectors."""
    scale = packed.select("scale").first()["scale"]
    pack = lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.bround(x.cast("double") * scale))).cast("double")
    own = queries.select("query_id", F.transform(vector, pack).alias("int8"))
    coarse = nearest_many(packed.select(key, F.col("int8").cast("array<double>").alias("int8")), own, k * oversample, key, "int8")
    rows = coarse.select("query_id", key).join(packed.select(key, vector), key).join(queries.select("query_id", F.col(vector).alias("_q")), "query_id")
    far = distance(F.col(vector).cast("array<double>"), F.col("_q").cast("array<double>"))
    w = Window.partitionBy("query_id").orderBy("distance", key)
    rows = rows.select("query_id", key, far.alias("distance")).withColumn("rank", F.row_number().over(w))
    return rows.filter(F.col("rank") <= k)


def cosine_of(distance_: Column) -> Column:
    """The cosine of unit vectors at a distance."""
    return 1 - distance_ * distance_ / 2


def semantic_score(distance_: Column) -> Column:
    return 1 / (1 + distance_)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def best_chunks(found: DataFrame, group: str = "revision_id", tie: Sequence[str] = ("start",)) -> DataFrame:
    """One row of each group: the nearest, then by tie."""
    w = Window.partitionBy(group).orderBy("distance", *tie)
    return found.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def semantic_hits(vectors: DataFrame, query: Sequence[float], limit: int, allowed: DataFrame | None = None, floor: float = NOISE_FLOOR) -> DataFrame:
    """revision_id, start, end, distance, score and rank of the best chunks among min(5 * limit, 200) nearest ones.

    Chunks below the noise floor, and revisions that aren't allowed, are dropped before ranks are given.
    """
    q = F.array(*map(F.lit, query)).cast("array<double>")
    found = vectors.withColumn("distance", distance(F.col("embedding").cast("array<double>"), q)).orderBy("distance", "revision_id", "chunk").limit(min(5 * limit, 200))
    found = found.filter(cosine_of(F.col("distance")) >= floor)
    found = found if allowed is None else found.join(allowed.select("revision_id"), "revision_id", "left_semi")
    best = best_chunks(found).select("revision_id", "start", "end", "distance", semantic_score(F.col("distance")).alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", "start", "revision_id")))


def hybrid(exact: DataFrame, semantic: DataFrame, key: str = "revision_id") -> DataFrame:
    """Rank fusion of exact and semantic hits (key, rank): fused score and kind exact, semantic or both."""
    a, b = exact.select(key, F.col("rank").alias("exact_rank")), semantic.select(key, F.col("rank").alias("semantic_rank"))
    both = a.join(b, key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (CONSTANT + F.col(c)), F.lit(0.0))
    kind = F.when(F.col("semantic_rank").isNull(), "exact").when(F.col("exact_rank").isNull(), "semantic").otherwise("both")
    return both.select(key, (part("exact_rank") + part("semantic_rank")).alias("fused"), kind.alias("kind"))


def overlap_at(a: DataFrame, b: DataFrame, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """For each query the share of a's keys that b has too."""
    one, two = (df.groupBy(query).agg(F.collect_set(key).alias(n)) for df, n in ((a, "a"), (b, "b")))
    return one.join(two, query, "left").select(query, (F.size(F.array_intersect("a", F.coalesce("b", F.slice("a", 1, 0)))) / F.size("a")).alias("overlap"))


# What a vector index is and whether it can be used: meta is a dict of model, dimension, chunk, overlap, packing, built_at.


def index_state(meta: dict | None, wanted: dict, dimension: int | None = None, chunks: int | None = None) -> str | None:
    """Why an index can't serve a query, or None; a packing that isn't asked for is the index's own. Never an error."""
    if meta is None:
        return "index_not_built"
    if not meta.get("built_at"):
        return "index_building"
    if any(meta[k] != wanted[k] for k in ("model", "chunk", "overlap")) or wanted.get("packing") not in (None, meta["packing"]):
        return "index_version_mismatch"
    if dimension is not None and dimension != meta["dimension"]:
        return "provider_dimension_mismatch"
    return "index_empty" if chunks == 0 else None


def next_action(meta: dict | None, wanted: dict, lacking: int, stale: int) -> str:
    """What an index needs: full, reindex, convert (only its packing differs) or skip."""
    if meta is None or any(meta[k] != wanted[k] for k in ("model", "chunk", "overlap")):
        return "full"
    if not meta.get("built_at") or lacking or stale:
        return "reindex"
    return "convert" if wanted.get("packing") not in (None, meta["packing"]) else "skip"


def converted(vectors: DataFrame, packing: str) -> DataFrame:
    """Stored float vectors with their int8 or bit form beside them, without embedding anything again."""
    if packing == "int8":
        return packed_vectors(vectors)
    if packing == "bit":
        return vectors.withColumn("bits", packed_bits(F.col("embedding")))
    raise ValueError(f"unknown packing {packing!r}")


def purged(vectors: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """The index without revisions that were taken back."""
    return vectors.join(withdrawn.select("revision_id").distinct(), "revision_id", "left_anti")
