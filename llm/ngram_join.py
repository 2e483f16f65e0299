"""N-gram Jaccard join with rare-first prefix filtering (operator 3).

A document's set holds its distinct k-word shingles. In an order that puts rare shingles first, similar sets share one
among the first few; only these prefixes are posted and joined, with length, positional and suffix filters, before the exact
count. The order comes from a sketch of fixed size, to which every task adds all the shingles of its documents: frequent
shingles stand out from what shares their counters at any size of the input. Any order gives the same links, so the sketch
only saves work. Copies with equal sets are one id from the start.

Defined results: a null text or one without words has an empty set (n_shingles 0) and is linked with nothing; with fewer
words than k the whole sequence is one shingle; repeated rows and ids give a row each; rows without an id take part but
can't be anyone's smallest id. Shingles are told apart by 64-bit hashes. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Bits, Scratch, batch_of, by_ids, chunks, row_key, table, without_keys
from llm.linking import PACKED_DDL, Combiner, Linking, Row, bucket_count, combined
from llm.wordhash import parities, set_hash, shingle_sets, word_hashes

#: Counters of the sketch: 2 ** SKETCH_BITS of 4 bytes in a broadcast. A task counts up to 65535 in each.
SKETCH_BITS, PART = 20, 1 << 12
_SHIFT = np.uint64(64 - SKETCH_BITS)
#: Columns of 64 parities each that joined postings carry.
PARITY = [f"h{i}" for i in range(8)]


class Shingles:
    """The sets of some texts one behind the other: row and value, each set's size, and its signature."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, k: int):
        self.value, self.size = shingle_sets(*word_hashes(buf, off), k)
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.sig = set_hash(self.row, self.value, len(self.size)).view(np.int64)
        self.end = np.cumsum(self.size)

    def set(self, i: int) -> np.ndarray:
        return self.value[self.end[i] - self.size[i] : self.end[i]]


def profile(docs: DataFrame, k: int) -> DataFrame:
    """A row for each row of docs (id, key, text): id, key, n, sig and parities; and rows of the sketch, whose key is a part of it."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), *[(c, pa.int64()) for c in PARITY], ("wide", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for a, b, buf, off in chunks(batch.column(2)):
                s = Shingles(buf, off, k)
                np.add.at(counts, (s.value >> _SHIFT).astype(np.int64), np.uint32(1))
                bits, wide = parities(s.row, s.value, s.size, len(PARITY))
                yield batch_of(schema, batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), s.size, s.sig, *bits, wide, pa.nulls(b - a, pa.binary()))
        if counts.any():
            parts = np.minimum(counts, 0xFFFF).astype(np.uint16).reshape(-1, PART)
            at = np.flatnonzero(parts.any(1))
            none = pa.nulls(len(at), pa.int64())
            yield batch_of(schema, none, at, none, none, *[none] * len(PARITY), pa.nulls(len(at), pa.binary()), [zlib.compress(parts[i].tobytes(), 1) for i in at.tolist()])

    return docs.mapInArrow(run, "id long, key long, n long, sig long, " + ", ".join(f"{c} long" for c in PARITY) + ", wide binary, sketch binary")


def sketch_of(profiled: DataFrame) -> np.ndarray:
    """2 ** SKETCH_BITS counters at most come to the driver, whatever the input."""

    def run(rows: pa.Table) -> pa.Table:
        total = np.zeros(PART, np.uint64)
        for cell in rows["sketch"]:
            total += np.frombuffer(zlib.decompress(cell.as_py()), np.uint16)
        return pa.table({"key": rows["key"].slice(0, 1), "sketch": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    out = np.zeros((1 << SKETCH_BITS) // PART * PART, np.uint32).reshape(-1, PART)
    for r in profiled.filter("sketch is not null").select("key", "sketch").groupBy("key").applyInArrow(run, "key long, sketch binary").toLocalIterator():
        out[r["key"]] = np.frombuffer(r["sketch"], np.uint32)
    return out.ravel()


def postings(docs: DataFrame, k: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    shared, buckets = docs.sparkSession.sparkContext.broadcast(sketch), bucket_count(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, combiner = shared.value, Combiner(num, den, buckets)
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0)):
                s = Shingles(buf, off, k)
                _, one = np.unique(s.sig, return_index=True)
                one = one[s.size[one] > 0]
                prefixes = []
                for i in one.tolist():
                    own = s.set(i)
                    p = len(own) - -(-num * len(own) // den) + 1
                    if p < len(own):
                        own = own[np.argsort(counts[own >> _SHIFT], kind="stable")]  # ties stay in the order of their hashes
                    prefixes.append(own[:p])
                if prefixes:
                    many = np.array([len(p) for p in prefixes])
                    pos = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    yield from combiner.add(np.concatenate(prefixes).view(np.int64), np.repeat(s.sig[one], many), np.repeat(s.size[one], many), pos)
        yield from combiner.flush()

    return docs.mapInArrow(run, PACKED_DDL)


def positional(num: int, den: int):
    """Before the shingle in which two sets meet, and behind it, they share no more than the shorter part has."""

    def fits(x: Row, y: Row) -> Column:
        most = F.least(x("pos"), y("pos")) + F.least(x("n") - x("pos"), y("n") - y("pos"))
        return (num + den) * most >= num * (x("n") + y("n"))

    return fits


def as_sets(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sets from their bytes."""
    values = np.frombuffer(buf.tobytes(), np.uint64)
    return [values[a:b] for a, b in zip((off[:-1] // 8).tolist(), (off[1:] // 8).tolist(), strict=True)]


def linked_rows(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, scratch: Scratch, held: int | None = None) -> DataFrame:
    """id, key, n and c (a component's hash, null for empty sets) of every row of docs."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
    profiled = scratch.write(profile(own, k), "profile")
    found = combined(postings(own.select("text"), k, num, den, sketch_of(profiled)), scratch, num, den)
    rows = profiled.filter("sketch is null")
    first = rows.filter("n > 0").groupBy("sig").agg(F.min("key").alias("key"), F.min("n").alias("many"), *[F.min(c).alias(c) for c in PARITY], F.min("wide").alias("wide"))
    first = scratch.write(first.withColumnRenamed("sig", "id"), "sets")

    def blobs_of(ids: DataFrame) -> DataFrame:
        """Sets of signatures, from the first document that has each; what the bits let through besides joins with nothing."""
        wanted = scratch.write(by_ids(first.select("id", "key"), ids, "id").select("key"), "wanted")
        passes = Bits(wanted, "key").test()
        schema = pa.schema([("id", pa.int64()), ("blob", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: set[int] = set()
            for batch in batches:
                some = batch.filter(pa.array(passes(batch.column(0).to_numpy())))
                for _, _, buf, off in chunks(some.column(1)):
                    s = Shingles(buf, off, k)
                    new = {g: i for i, g in enumerate(s.sig.tolist()) if s.size[i] and g not in done}
                    done |= new.keys()
                    yield batch_of(schema, list(new), [s.set(i).tobytes() for i in new.values()])

        scratch.drop("wanted")
        return own.select("key", "text").mapInArrow(run, "id long, blob binary").dropDuplicates(["id"])

    linked = Linking(found, first.drop("key"), blobs_of, as_sets, scratch, num, den, positional(num, den), held).join_all()
    linked = scratch.write(linked.select(F.col("node").alias("sig"), "component"), "linked")
    scratch.drop("combined", "sets", "third-joined")
    out = by_ids(rows, linked, "sig", "left").select("id", "key", "n", F.when(F.col("n") > 0, F.coalesce("component", "sig")).alias("c"))
    out = scratch.write(out, "rows")
    scratch.drop("profile", "linked")
    return out


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", held: int | None = None) -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id reachable by links of den * shared >= num * union) for every row."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = linked_rows(docs, k, num, den, id_col, text_col, scratch, held)
    least = scratch.write(rows.filter("c is not null").groupBy("c").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("many")).filter("many > 1 or component_id is null").drop("many"), "least")
    return by_ids(rows, least, "c", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id, those without an id last.

    Of rows equal in id and text one stays. Documents without words stay, each row of them.
    """
    scratch = Scratch(docs.sparkSession, "ngram-dedup")
    rows = linked_rows(docs, k, num, den, id_col, text_col, scratch).filter("c is not null")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    first = scratch.write(rows.groupBy("c").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("c", F.col("first.key").alias("first")), "first")
    several = scratch.write(by_ids(rows, first, "c", "inner").select("key", "first"), "several")
    once = several.filter("key = first").groupBy("key").count().filter("count > 1").select("key")
    drop = scratch.write(several.filter("key <> first").select("key").distinct(), "drop")
    return without_keys(docs, drop, id_col, text_col, scratch.write(once, "once"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100)
