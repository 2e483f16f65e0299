"""What leads where along a relation, by semi-naive iteration over tables: each round joins only what the last one found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators.scratch import written


def reached(edges: DataFrame, starts: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """start and node for all nodes that each start leads to by one edge or more; edges: source and target, starts: start.

    Every pair is found once, circles included, so it ends after as many rounds as the longest way has edges. With goals
    (start, goal) only these pairs are followed up to their goal, and only starts with a goal left go on.
    """
    edges = written(edges.select("source", "target").filter("source is not null and target is not null").distinct())
    new = written(starts.select("start").distinct().join(edges, F.col("start") == F.col("source")).select("start", F.col("target").alias("node")).distinct())
    every = new
    while not new.isEmpty():
        front = new
        if goals is not None:
            left = goals.join(every.select("start", F.col("node").alias("goal")), ["start", "goal"], "left_anti").select("start").distinct()
            front = new.join(left, "start", "left_semi")
        found = front.join(edges, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
        new = written(found.join(every, ["start", "node"], "left_anti"))
        every = written(every.unionByName(new))
    return every


def on_circles(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """The proposed edges (source, target) that would lie on a circle of all edges and proposals together, found at once."""
    both = edges.select("source", "target").unionByName(proposed.select("source", "target"))
    goals = proposed.select(F.col("target").alias("start"), F.col("source").alias("goal")).distinct()
    back = reached(both, goals.select("start"), goals).select(F.col("start").alias("target"), F.col("node").alias("source"))
    found = proposed.join(back, ["source", "target"], "left_semi").select("source", "target")
    return found.unionByName(proposed.filter("source = target").select("source", "target")).distinct()
