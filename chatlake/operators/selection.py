"""Exact nearest-rank percentiles without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Values of a group that one task sorts; accuracy of the sketches, and into how many parts they cut a bracket.
SELECTED, ACCURACY, CUTS = 1_000, 2_000, 200


def nearest_place(share: float, n: int) -> int:
    """The place of a nearest-rank percentile among n sorted values: halves go to the even one."""
    return round(share * (n - 1))


@dataclass
class Bracket:
    """The n values from low to high, among which the one at a place is wanted."""

    number: int
    group: tuple
    share: float
    place: int
    low: float
    high: float
    n: int

    def found(self) -> bool:
        return self.low == self.high


class Selection:
    def __init__(self, rows: DataFrame, value: str, by: Sequence[str]):
        """rows as _g (the group, a struct, so null is a group too) and _v."""
        self.spark, self.by = rows.sparkSession, list(by)
        group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
        self.rows = rows.filter(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).cast("double").alias("_v"))
        self.kind = self.rows.schema["_g"].dataType

    def within(self, brackets: Sequence[Bracket], more: dict[str, Sequence[float]] | None = None) -> DataFrame:
        """_k (a bracket's number), _v and further numbers of the bracket, for the values inside of the brackets."""
        more = more or {}
        own = [(tuple(b.group), b.number, b.low, b.high, *[m[i] for m in more.values()]) for i, b in enumerate(brackets)]
        fields = [StructField("_h", self.kind), StructField("_k", LongType()), *[StructField(n, DoubleType()) for n in ("_low", "_high", *more)]]
        held = self.spark.createDataFrame(own, StructType(fields))
        found = self.rows.join(F.broadcast(held), F.col("_g") == F.col("_h"))  # a row for each open bracket
        return found.filter(F.col("_v").between(F.col("_low"), F.col("_high"))).select("_k", "_v", *more)

    def narrowed(self, brackets: Sequence[Bracket]) -> list[Bracket]:
        """Each bracket's part that holds its place: a sketch tells where to cut, exact counts tell which part it is."""
        sketch = self.within(brackets).groupBy("_k").agg(F.percentile_approx("_v", [i / CUTS for i in range(CUTS + 1)], ACCURACY).alias("c"))
        points = {r["_k"]: r["c"] for r in sketch.collect()}
        near = [b.place / (b.n - 1) * CUTS for b in brackets]
        cuts = [(points[b.number][max(0, int(x) - 1)], points[b.number][min(CUTS, int(x) + 2)]) for b, x in zip(brackets, near, strict=True)]
        rows = self.within(brackets, {"_a": [a for a, _ in cuts], "_b": [b for _, b in cuts]})
        v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
        part = F.when(v < a, 0).when(v == a, 1).when(v < b, 2).when(v == b, 3).otherwise(4).alias("part")
        parts = rows.groupBy("_k", part).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        counted: dict[int, list] = {}
        for r in parts.collect():
            counted.setdefault(r["_k"], []).append((r["part"], r["n"], r["low"], r["high"]))
        out = []
        for bracket in brackets:
            place = bracket.place
            for _, n, low, high in sorted(counted[bracket.number]):
                if place < n:
                    out.append(replace(bracket, place=place, low=low, high=high, n=n))
                    break
                place -= n
        return out

    def small(self, shares: Sequence[float]) -> DataFrame:
        """_g, share and value of groups of at most SELECTED values, each sorted by one task."""
        sizes = self.rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= SELECTED)
        values = self.rows.join(sizes, "_g").groupBy("_g", "n").agg(F.sort_array(F.collect_list("_v")).alias("v"))
        at = lambda s: F.bround(F.lit(s) * (F.col("n") - 1)).cast("int")
        picked = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.get("v", at(float(s))).alias("value")) for s in shares])
        return values.select("_g", F.explode(picked).alias("x")).select("_g", "x.*")

    def large(self, shares: Sequence[float]) -> DataFrame:
        """_g, share and value of the other groups."""
        sizes = self.rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        sizes = sizes.filter(F.col("n") > SELECTED).collect()
        left = [(tuple(r["_g"]), float(s), nearest_place(s, r["n"]), r["low"], r["high"], r["n"]) for r in sizes for s in shares]
        left, few, done = [Bracket(i, *x) for i, x in enumerate(left)], [], []
        while left:
            done += [b for b in left if b.found()]
            few += [b for b in left if not b.found() and b.n <= SELECTED]
            left = [b for b in left if not b.found() and b.n > SELECTED]
            left = self.narrowed(left) if left else []
        values = {}
        if few:
            sorted_ = self.within(few).groupBy("_k").agg(F.sort_array(F.collect_list("_v")).alias("v"))
            place = F.element_at(F.create_map(*[F.lit(x) for b in few for x in (b.number, b.place)]), F.col("_k").cast("int"))
            values = {r["_k"]: r["value"] for r in sorted_.select("_k", F.get("v", place).alias("value")).collect()}
        rows = [(b.group, b.share, b.low) for b in done] + [(b.group, b.share, values[b.number]) for b in few]
        fields = [StructField("_g", self.kind), StructField("share", DoubleType()), StructField("value", DoubleType())]
        return self.spark.createDataFrame(rows, StructType(fields))


def percentiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, share and value: the value at place round(share * (n - 1)) of each group's sorted values, halves to the even place.

    A group of up to SELECTED values is sorted. In a larger one the wanted place is bracketed, again and again: a sketch, which
    tasks merge, gives two values near it, and exact counts below, at, between and above them tell which part holds the place,
    until that is one value or small enough to be sorted. A sketch that errs costs a round, not the result. Values are doubles;
    null ones don't count. The driver holds a row for each share of each larger group.
    """
    own = Selection(rows, value, by)
    every = own.small(shares).unionByName(own.large(shares))
    return every.select(*[F.col("_g").getField(b).alias(b) for b in own.by], "share", "value")
