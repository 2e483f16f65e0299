"""Connected components of a distributed edge table.

Up to HELD edges, a counted and fixed bound, one task joins them up in memory. Beyond it, alternating large and small stars:
each step links nodes to the least node next to them; edges end as stars around the least node of each component. All
those steps are aggregations with partial sums and joins that adaptive execution can split, so a star with very many rays
does not land in one task. Nothing is collected but counts. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Scratch, batch_of

#: Edges that one task joins up: 16 bytes each, and about 100 while it works.
HELD = 1_000_000
_OUT = pa.schema([("node", pa.int64()), ("component", pa.int64())])


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), sorted, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        least = np.minimum(up[x], up[y])
        np.minimum.at(up, up[x], least)
        np.minimum.at(up, up[y], least)
        while ((further := up[up]) != up).any():
            up = further
        open_ = up[x] != up[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[up]


def in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if held:
        nodes, least = least_nodes(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for i in range(0, len(nodes), 100_000):
            some = slice(i, i + 100_000)
            moved = nodes[some] != least[some]
            yield batch_of(_OUT, nodes[some][moved], least[some][moved])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", held: int = HELD) -> DataFrame:
    """node and component (its least node) for every node of edges (a, b: long) but the least ones themselves."""
    edges = scratch.write(edges.select("a", "b").filter("a <> b"), f"{name}-edges")
    if edges.count() <= held:
        return scratch.write(edges.repartition(1).mapInArrow(in_one_task, "node long, component long"), f"{name}-joined")
    return by_stars(edges, scratch, name)


def by_stars(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    state = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    state, rounds = scratch.write(state, f"{name}-0"), 0

    def least(df: DataFrame, step: str) -> DataFrame:
        return scratch.write(df.groupBy("hi").agg(F.min("lo").alias("m")), f"{name}-min-{step}")

    while True:
        mins = least(state, f"s{rounds}")
        joined = state.join(mins, "hi")
        small = joined.select("hi", F.col("m").alias("lo")).union(joined.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()
        small = scratch.write(small, f"{name}-small-{rounds}")
        mins = least(small, f"l{rounds}")
        inner = small.join(mins.select(F.col("hi").alias("lo"), "m"), "lo", "left_semi").count()
        if not inner and mins.count() == small.count():
            return small.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        large = small.join(mins.select(F.col("hi").alias("lo"), "m"), "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        state = scratch.write(large, f"{name}-large-{rounds}")
        rounds += 1
