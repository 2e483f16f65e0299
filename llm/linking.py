"""From postings (token, id) to the components of ids whose sets are similar, without all pairs of a token's ids.

1. Map tasks sort their postings by token. Ids that share a token there are linked to the first of them as candidates, and
   only that one is posted on; where the posts of all tasks meet, they are linked to their first in turn. Postings travel
   as arrays, one row for each task and bucket of tokens, so neither the shuffle nor the sort touches single rows.
2. Each id's best candidate is verified, and the links' components are found. A group of copies is one component now.
3. Where a token with many members still has several components, LEADERS other ids of it lead, and the members of other
   components are verified against them, the nearest of each rank, once.
4. Every other pair that shares a token lies in two components: these pairs are formed token by token between members of
   different components only, filtered, verified once each, and the components found again.

So each pair that shares a token is verified or already connected, and no link between different texts is lost. Before a
pair's sets are fetched, it has to pass the filters: traits (sizes, parities) are joined to pairs first, sets to what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import CHUNK_BYTES, Scratch, batch_of, by_ids, text_arrays
from llm.components import components
from llm.wordhash import differing, mix

PAIR, SHARED, POST = 0, 1, 2
#: Postings that a map task holds before it combines and hands them on.
HELD = 500_000
#: Bytes of input for a bucket at most, and buckets for each shuffle partition at least.
BUCKET_BYTES, BUCKETS = 32 << 20, 4
#: Leaders in step 3, and members of a token up to which it is left to step 4: any numbers give the same components.
LEADERS, FEW = 3, 8
#: What travels: the rows of one kind for one bucket, each column's values as bytes.
PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("token", pa.binary()), ("id", pa.binary()), ("n", pa.binary()), ("pos", pa.binary())])
PACKED_DDL = "bucket int, kind tinyint, token binary, id binary, n binary, pos binary"
ROWS = pa.schema([("kind", pa.int8()), ("token", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])
ROWS_DDL = "kind tinyint, token long, id long, n long, pos long"
_U = np.uint64
Columns = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def bucket_count(docs: DataFrame) -> int:
    """Buckets that hold at most about BUCKET_BYTES of the input each, by the sizes of its files."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(BUCKETS * partitions, min(size // BUCKET_BYTES, 1 << 22))


def packed(kind: int, buckets: int, key: np.ndarray, token: np.ndarray, ids: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows by the leading bits of key, which must be spread evenly."""
    bucket = (key.view(_U) >> _U(32)) * _U(buckets) >> _U(32)
    if (bucket[1:] < bucket[:-1]).any():
        order = np.argsort(bucket)
        bucket, token, ids, n, pos = bucket[order], token[order], ids[order], n[order], pos[order]
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    spans = list(zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True)) if len(at) else []
    cells = [[x[a:b].tobytes() for a, b in spans] for x in (token.view(np.int64), ids.view(np.int64), n.astype(np.int64), pos.astype(np.int32))]
    return batch_of(PACKED, bucket[at].astype(np.int32), np.full(len(at), kind, np.int8), *cells)


def unpacked(table: pa.Table, kind: int) -> Columns:
    """token, id, n and pos of the rows of one kind."""
    at = np.flatnonzero(table["kind"].to_numpy() == kind)
    cells = lambda c, t: np.frombuffer(b"".join(table[c].take(at).to_pylist()), t)
    return cells("token", np.int64), cells("id", np.int64), cells("n", np.int64), cells("pos", np.int32)


def rows(kind: int, token: np.ndarray, ids: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return batch_of(ROWS, np.full(len(token), kind, np.int8), token.view(np.int64), ids.view(np.int64), n.astype(np.int64), pos.astype(np.int64))


def linked(token: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """For rows sorted by (token, n, id): the index of each row's leader, its own index if it leads.

    A leader is the first of its token, or the first that is too long for the leader before it.
    """
    new = changes(token, token)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    long = np.flatnonzero(den * n[lead] < num * n)
    if len(long):  # only the tokens with such a row are walked
        sizes, end = n.tolist(), len(token)
        for start in np.unique(lead[long]).tolist():
            j = i = start
            while i < end and lead[i] == start:
                j = i if den * sizes[j] < num * sizes[i] else j
                lead[i] = j
                i += 1
    return lead


def changes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where (a, b) isn't what it is one place before."""
    out = np.ones(len(a), bool)
    out[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return out


def grouped(token: np.ndarray, ids: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[Columns, Columns]:
    """Rows that are alone with their token, and the others sorted by (token, n, id), each (token, id) once."""
    order = np.argsort(token)
    t = token[order]
    same = t[1:] == t[:-1]
    several = np.zeros(len(t), bool)
    several[1:] |= same
    several[:-1] |= same
    one, more = order[~several], order[several]
    more = more[np.lexsort((pos[more], ids[more], n[more], token[more]))]
    more = more[changes(token[more], ids[more])]
    return tuple(x[one] for x in (token, ids, n, pos)), tuple(x[more] for x in (token, ids, n, pos))


def in_company(token: np.ndarray) -> np.ndarray:
    out = np.zeros(len(token), bool)
    same = token[1:] == token[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


class Combiner:
    """Holds a map task's postings and combines those that share a token; tokens and ids are evenly spread hashes."""

    def __init__(self, num: int, den: int, buckets: int):
        self.num, self.den, self.buckets, self.held, self.size = num, den, buckets, [], 0

    def add(self, token: np.ndarray, ids: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((token, ids, n, pos))
        self.size += len(token)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        one, (token, ids, n, pos) = grouped(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        self.held, self.size = [], 0
        lead = linked(token, n, self.num, self.den)
        leads, several = lead == np.arange(len(lead)), in_company(token)
        behind = mix(ids.view(_U) + _U(3))
        yield packed(PAIR, self.buckets, behind[~leads], ids[lead[~leads]], ids[~leads], np.ones(int((~leads).sum())), pos[~leads])
        yield packed(SHARED, self.buckets, mix(token.view(_U) ^ behind)[several], token[several], ids[several], n[several], pos[several])
        token, ids, n, pos = (np.concatenate((a, b[leads])) for a, b in zip(one, (token, ids, n, pos), strict=True))
        yield packed(POST, self.buckets, token, token, ids, n, pos)


def met(table: pa.Table, num: int, den: int) -> list[pa.RecordBatch]:
    """PAIR rows (token the leader, id the other, n how often) and SHARED rows of one bucket."""
    a, b, _, _ = unpacked(table, PAIR)
    token, ids, n, pos = unpacked(table, SHARED)
    keep = np.lexsort((ids, token))
    keep = keep[changes(token[keep], ids[keep])]
    out = [rows(SHARED, token[keep], ids[keep], n[keep], pos[keep])]
    _, (token, ids, n, pos) = grouped(*unpacked(table, POST))
    lead = linked(token, n, num, den)
    own, several = lead == np.arange(len(lead)), in_company(token)
    out.append(rows(SHARED, token[several], ids[several], n[several], pos[several]))
    a, b = np.concatenate((a, ids[lead[~own]])), np.concatenate((b, ids[~own]))
    if len(a):
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        at = np.flatnonzero(changes(a, b))
        out.append(rows(PAIR, a[at], b[at], np.diff(np.concatenate((at, [len(a)]))), np.zeros(len(at))))
    return out


def combined(mapped: DataFrame, scratch: Scratch, num: int, den: int, others: Callable[[pa.Table], list[pa.RecordBatch]] | None = None) -> DataFrame:
    """What the buckets of packed rows give, written; others makes rows of kinds that aren't known here."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([*met(table, num, den), *(others(table) if others else [])], ROWS)

    out = scratch.write(mapped.groupBy("bucket").applyInArrow(run, ROWS_DDL), "combined")
    scratch.release()
    return out


Sets = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether den * intersection >= num * union, of sorted sets that aren't empty."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or den * len(x) < num * len(y):
        return False
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return den * both >= num * (len(x) + len(y) - both)


def verified(pairs: DataFrame, blobs: DataFrame, sets: Sets, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets are similar; blobs: id and blob (binary), a written table, from which sets makes them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sides = [text_arrays(batch.column(i)) for i in (2, 3)]
            size, at, good = sides[0][1] + sides[1][1], 0, []
            while at < len(a):
                end = max(at + 1, int(np.searchsorted(size, size[at] + CHUNK_BYTES, side="right")) - 1)
                x, y = (sets(buf[off[at] : off[end]], off[at : end + 1] - off[at]) for buf, off in sides)
                good += [i for i, (s, t) in enumerate(zip(x, y, strict=True), at) if similar(s, t, num, den)]
                at = end
            yield batch_of(schema, a[good], b[good])

    one, two = blobs.select(F.col("id").alias("a"), F.col("blob").alias("x")), blobs.select(F.col("id").alias("b"), F.col("blob").alias("y"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


Row = Callable[[str], Column]


def apart(x: Row, y: Row, parity: list[str]) -> Column:
    """In how many bits the parities of two sets differ: at least as many elements are in only one of them."""
    return sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in parity[1:]), F.bit_count(x(parity[0]).bitwiseXOR(y(parity[0]))))


def near(pairs: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """The written pairs (a, b) whose sizes and strings of parities allow that they are similar. wide: id, many, wide."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, m, n = (batch.column(i).to_numpy() for i in range(4))
            far = np.array([differing(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
            good = (den * np.minimum(m, n) >= num * np.maximum(m, n)) & ((num + den) * (m + n - far) >= 2 * num * (m + n))
            yield batch_of(schema, a[good], b[good])

    one, two = (wide.select(F.col("id").alias(i), F.col("many").alias(n), F.col("wide").alias(w)) for i, n, w in (("a", "m", "v"), ("b", "n", "w")))
    return pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "m", "n", "v", "w").mapInArrow(run, "a long, b long")


def of(side: str) -> Row:
    return lambda c: F.col(f"{side}.{c}")


class Linking:
    """node, component of ids, least nodes left out, by join_all().

    found is what combined() wrote. traits has one row for each id of it: id, many (the size of its set), columns of
    parities and wide, their longer string. blobs_of(ids) gives id and blob of a table of ids. fits(x, y), an optional filter, says of two
    postings of one token whether their sets can be similar by what they share, from n and pos.
    """

    def __init__(self, found: DataFrame, traits: DataFrame, blobs_of: Callable[[DataFrame], DataFrame], sets: Sets, scratch: Scratch, num: int, den: int, fits: Callable[[Row, Row], Column] | None = None, held: int | None = None):
        self.parity = [c for c in traits.columns if c not in ("id", "many", "wide")]
        self.found, self.traits, self.wide = found, traits.drop("wide"), traits.select("id", "many", "wide")
        self.blobs_of, self.sets, self.scratch, self.num, self.den, self.positional = blobs_of, sets, scratch, num, den, fits
        self.limit = {} if held is None else {"held": held}

    def fit(self, x: Row, y: Row) -> Column:
        """Sizes are near enough, so few bits of the parities differ as similar sets allow, and positions too."""
        num, den, both = self.num, self.den, x("many") + y("many")
        sizes = den * F.least(x("many"), y("many")) >= num * F.greatest(x("many"), y("many"))
        alike = sizes & ((num + den) * (both - apart(x, y, self.parity)) >= 2 * num * both)
        return alike if self.positional is None else self.positional(x, y) & alike

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The similar ones of written pairs (a, b)."""
        close = self.scratch.write(near(pairs, self.wide, self.num, self.den), f"{name}-near")
        ids = close.select(F.col("a").alias("id")).union(close.select(F.col("b").alias("id"))).distinct()
        blobs = self.scratch.write(self.blobs_of(self.scratch.write(ids, f"{name}-ids")), f"{name}-blobs")
        out = self.scratch.write(verified(close, blobs, self.sets, self.num, self.den), f"{name}-links")
        self.scratch.drop(f"{name}-near", f"{name}-ids", f"{name}-blobs")
        self.scratch.release()
        return out

    def best(self) -> DataFrame:
        """Each id's most frequent candidate."""
        best = self.found.filter(F.col("kind") == PAIR).groupBy(F.col("token").alias("a"), F.col("id").alias("b")).agg(F.sum("n").alias("count"))
        return self.scratch.write(best.groupBy("b").agg(F.max(F.struct("count", "a")).alias("top")).select("top.a", "b"), "best")

    def with_component(self, shared: DataFrame, joined: DataFrame) -> DataFrame:
        out = by_ids(shared.drop("component"), joined.withColumnRenamed("node", "id"), "id", "left")
        return out.withColumn("component", F.coalesce("component", "id"))

    def parted(self, joined: DataFrame) -> DataFrame:
        """The postings of tokens with several components, with their components and traits.

        before is the token that the same id shares just before this one; crowd tells tokens of more than FEW members.
        """
        order = Window.partitionBy("id").orderBy("pos", "token")
        shared = self.found.filter(F.col("kind") == SHARED).select("token", "id", "n", "pos").withColumn("before", F.lag("token").over(order))
        shared = self.scratch.write(self.with_component(shared, joined), "shared")
        split = shared.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members")).filter("x <> y").select("token", (F.col("members") > FEW).alias("crowd"))
        out = self.scratch.write(shared.join(split, "token").join(self.traits, "id"), "parted")
        self.scratch.drop("shared")
        return out

    def led(self, shared: DataFrame) -> DataFrame:
        """Pairs of members with the nearest leader of each rank, of another component."""
        shared = shared.filter("crowd")
        columns = [c for c in shared.columns if c not in ("token", "before", "crowd")]
        leads = [F.min(F.struct(F.xxhash64("id", F.lit(j)).alias("h"), *columns)).alias(f"lead{j}") for j in range(LEADERS)]
        each = F.array(*[F.struct(F.lit(j).alias("nth"), *[F.col(f"lead{j}.{c}") for c in columns]) for j in range(LEADERS)])
        lead = shared.groupBy("token").agg(*leads).select("token", F.explode(each).alias("lead")).select("token", "lead.*")
        new = shared.alias("x").join(lead.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & self.fit(of("x"), of("y")))
        new = new.groupBy(F.col("x.id").alias("b"), F.col("y.nth").alias("nth")).agg(F.min(F.struct(apart(of("x"), of("y"), self.parity).alias("far"), F.col("y.id").alias("a"))).alias("top"))
        return self.scratch.write(new.select("top.a", "b").distinct(), "led")

    def rest(self, shared: DataFrame, joined: DataFrame) -> DataFrame:
        """All other pairs of a token that pass: members of a crowd's largest component meet only the others, not each other."""
        shared = self.with_component(shared, joined)
        top = shared.filter("crowd").groupBy("token", "component").count().groupBy("token").agg(F.max(F.struct("count", "component")).alias("top"))
        top = self.scratch.write(top.select("token", F.col("top.component").alias("largest")), "top")
        shared = by_ids(shared, top, "token", "left").withColumn("inner", F.coalesce(F.col("component") == F.col("largest"), F.lit(False))).drop("largest", "crowd")
        once = ~F.col("x.inner") & ((F.col("x.component") < F.col("y.component")) | (F.col("y.inner") & (F.col("x.component") != F.col("y.component"))))
        new = F.coalesce(F.col("x.before") != F.col("y.before"), F.lit(True))  # else the pair meets at the token before too
        pairs = shared.alias("x").join(shared.alias("y"), (F.col("x.token") == F.col("y.token")) & once & new & self.fit(of("x"), of("y")))
        pairs = self.scratch.write(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "rest")
        self.scratch.drop("top")
        return pairs

    def join_up(self, joined: DataFrame, links: DataFrame, name: str) -> DataFrame:
        return components(links.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))), self.scratch, name, **self.limit)

    def join_all(self) -> DataFrame:
        joined = components(self.links(self.best(), "first"), self.scratch, "first", **self.limit)
        shared = self.parted(joined)
        more = self.links(self.led(shared), "led")
        joined = self.join_up(joined, more, "second")
        more = self.links(self.rest(shared, joined), "rest")
        joined = self.join_up(joined, more, "third")
        self.scratch.drop("parted", "best", "led", "rest", *[f"{x}-links" for x in ("first", "led", "rest")], *[f"{x}-edges" for x in ("first", "second", "third")], "first-joined", "second-joined")
        return joined
