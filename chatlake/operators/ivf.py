"""Nearest neighbours of many vectors at once: exactly, or by an index of inverted lists.

The index deals all vectors to the lists of their nearest centroids; a query looks into the lists of its own nearest ones.
Centroids come from k-means over at most SAMPLE vectors (those with the least hash of their keys), all vectors are indexed.
With as many probes as lists the search is exact. Vectors and queries meet by list, and large lists in blocks of it, as
matrices; each block gives its k nearest for each query, and these meet by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

#: Vectors that k-means sees; most lists; queries broadcast at once in an exact search; rows of a block.
SAMPLE, LISTS, LOT, BLOCK = 50_000, 4096, 2048, 65_536
#: Queries multiplied at once with all vectors of a block or batch, at most, and numbers of such a product, of which a task
#: holds about five; queries of a group that meets a block in one task, at most about.
TILE, CELLS, ASKED = 1024, 1 << 20, 65_536


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of doubles; the lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def nearest_of(vectors: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, distances) of the k nearest vectors of each query, and of all others as near as the last.

    A product of matrices finds what may be among them; the distances of these are summed component by component.
    """
    size = (vectors * vectors).sum(1)
    step = max(1, min(TILE, CELLS // len(vectors)))
    for a in range(0, len(queries), step):
        some = queries[a : a + step]
        far = size[None, :] - 2 * some @ vectors.T + (some * some).sum(1)[:, None]
        last = np.partition(far, min(k, far.shape[1]) - 1, axis=1)[:, min(k, far.shape[1]) - 1]
        slack = 1e-9 * (size.max() + (some * some).sum(1))
        for i in range(len(some)):
            at = np.flatnonzero(far[i] <= last[i] + slack[i])
            yield a + i, at, np.sqrt(((vectors[at] - some[i]) ** 2).sum(1))


def _out(queries: DataFrame, vectors: DataFrame, key: str) -> StructType:
    return StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField(key, vectors.schema[key].dataType), StructField("distance", DoubleType())])


def _found(schema: pa.Schema, asked: pa.Array, keys: pa.Array, vectors: np.ndarray, queries: np.ndarray, k: int) -> pa.Table:
    who, what, far = [], [], []
    for i, at, d in nearest_of(vectors, queries, k) if len(vectors) else ():
        who.append(np.full(len(at), i))
        what.append(at)
        far.append(d)
    if not who:
        return schema.empty_table()
    columns = [asked.take(pa.array(np.concatenate(who))), keys.take(pa.array(np.concatenate(what))), pa.array(np.concatenate(far))]
    return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def first(found: DataFrame, k: int, key: str) -> DataFrame:
    """The k nearest of each query by distance, then key, with rank."""
    w = Window.partitionBy("query_id").orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, distance and rank: every query against every vector, LOT queries at a time.

    queries: query_id and a vector of the same name.
    """
    out = _out(queries, vectors, key)
    schema = to_arrow_schema(out)
    held = queries.select("query_id", vector).toArrow()  # a stated set of queries
    every = None
    for a in range(0, max(held.num_rows, 1), LOT):
        lot = held.slice(a, LOT).combine_chunks()
        shared = queries.sparkSession.sparkContext.broadcast((lot.column(0).combine_chunks() if lot.num_rows else None, matrix(lot.column(1))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, own = shared.value
            for batch in batches:
                if asked is not None and batch.num_rows:
                    yield from _found(schema, asked, batch.column(0), matrix(batch.column(1)), own, k).to_batches()

        one = vectors.select(key, vector).mapInArrow(run, out)
        every = one if every is None else every.unionByName(one)
    return first(every, k, key)


@dataclass
class Index:
    """rows: list, block, key and vector; centroids: one row a list."""

    rows: DataFrame
    centroids: np.ndarray
    key: str
    vector: str


def centroids(vectors: DataFrame, lists: int, key: str = "vec_id", vector: str = "embedding", seed: int = 1, rounds: int = 8) -> np.ndarray:
    """Centroids of k-means over the sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if not 1 <= lists <= LISTS:
        raise ValueError(f"1 to {LISTS} lists")
    sample = vectors.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return np.stack(KMeans(k=lists, seed=seed, maxIter=rounds).fit(sample).clusterCenters())


def dealt(vectors: DataFrame, centers: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """list, key and vector of all vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)
    rows = vectors.select(key, vector)
    out = StructType([*StructType.fromDDL("list int").fields, *rows.schema.fields])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1))
                near = ((c * c).sum(1)[None, :] - 2 * v @ c.T).argmin(1)
                columns = [pa.array(near, pa.int32()), *batch.columns]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, out)


def blocks(rows: DataFrame, key: str) -> DataFrame:
    """rows with block: lists of more than BLOCK rows are split by the key's hash."""
    sizes = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = rows.join(F.broadcast(sizes), "list")  # at most LISTS rows
    return placed.withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks")


def search(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, key, distance and rank: the nearest in the probes lists nearest to each query."""
    c, key, vector = index.centroids, index.key, index.vector
    shared, probes = queries.sparkSession.sparkContext.broadcast(c), min(probes, len(c))
    rows = queries.select("query_id", vector)
    asked = StructType([*StructType.fromDDL("list int").fields, *rows.schema.fields])
    asked_schema, out = to_arrow_schema(asked), _out(queries, index.rows, key)
    schema = to_arrow_schema(out)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for batch in batches:
            if batch.num_rows:
                far = (centers * centers).sum(1)[None, :] - 2 * matrix(batch.column(1)) @ centers.T
                near = np.argpartition(far, probes - 1, axis=1)[:, :probes]
                at = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                columns = [pa.array(near.ravel(), pa.int32()), *[x.take(at) for x in batch.columns]]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, asked_schema, strict=True)], schema=asked_schema)

    def meet(own: pa.Table, theirs: pa.Table) -> pa.Table:
        if not own.num_rows or not theirs.num_rows:
            return schema.empty_table()
        return _found(schema, theirs["query_id"].combine_chunks(), own[key].combine_chunks(), matrix(own[vector]), matrix(theirs[vector]), k)

    there = index.rows.select(F.col("list").alias("list"), F.col("block").alias("block")).distinct()
    lots = max(1, -(-rows.count() // ASKED))
    lot = F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int")
    met = rows.mapInArrow(probe, asked).join(F.broadcast(there), "list").withColumn("lot", lot)  # a row a list and block
    held = index.rows.select("list", "block", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), key, vector)
    group = ["list", "block", "lot"]
    found = held.groupBy(*group).cogroup(met.groupBy(*group)).applyInArrow(meet, out)
    return first(found, k, key)


#: Queries by which the number of probes is chosen.
TRIED = 128


def probes_for(index: Index, share: float, k: int) -> int:
    """The least number of probes that finds a share of the k nearest of TRIED of the indexed vectors (least hash of keys)."""
    key, vector, c = index.key, index.vector, index.centroids
    tried = index.rows.orderBy(F.xxhash64(key, F.lit("tried")), key).limit(TRIED).select(F.col(key).alias("query_id"), vector)
    truth = exact(index.rows, tried, k, key, vector).select("query_id", F.col(key).alias("_near"))
    pairs = truth.join(index.rows.select(F.col(key).alias("_near"), F.col("list").alias("_list")), "_near").select("query_id", "_list").collect()
    held = tried.toArrow()
    far = (c * c).sum(1)[None, :] - 2 * matrix(held[vector]) @ c.T
    order = dict(zip(held["query_id"].to_pylist(), far.argsort(1).argsort(1), strict=True))
    places = sorted(int(order[r["query_id"]][r["_list"]]) for r in pairs)
    return places[min(len(places) - 1, int(np.ceil(share * len(places))))] + 1 if places else len(c)


def recall(found: DataFrame, truth: DataFrame, key: str = "vec_id") -> DataFrame:
    """queries, and the mean share of the true neighbours that were found."""
    hit = truth.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    one = hit.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
    return one.agg(F.count(F.lit(1)).alias("queries"), F.avg("share").alias("recall"))
