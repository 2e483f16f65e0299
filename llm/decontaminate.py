"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 10).

Benchmark windows become byte strings of words between single spaces, and so do the documents. Over a document text,
cursors jump by a table of block shifts; where the shift is 0, the bucket of the block's hash selects the strings that
may end there, and comparing bytes confirms them. Many cursors move in step, each over its own stretch of the text.

Defined results: a null text has no words and no hits; an item without words has no window; an item shorter than the
window is one window of its own; rows with one item_id are one item of several texts; windows of items without an id hit
words, but these items aren't counted or listed; an empty benchmark contaminates nothing; documents keep one row for each
input row, repeated ids included, and are removed row by row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Scratch, batch_of, chunks, row_key, table, without_keys
from llm.wordhash import LOWER, NOT_WORD, word_bounds

WINDOW = 13
#: Bytes of patterns that one pass holds and broadcasts; a larger benchmark is searched in several passes.
PATTERN_BYTES = 24 << 20
#: Patterns of at least so many bytes are searched with eight-byte blocks, shorter ones apart.
LONG = 24
STRETCH = 1024
_MULT = np.uint64(0x9E3779B97F4A7C15)


def spaced(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as ` word word ... word \\n`, where each word starts there, and the offsets of each text's words."""
    data = LOWER[buf]
    starts, ends, words, inside = word_bounds(data, off, NOT_WORD)
    lens = ends - starts
    begin = np.concatenate(([0], np.cumsum(lens)))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(words))
    at = begin[:-1] + np.arange(len(lens)) + 1 + 2 * doc
    out = np.full(begin[-1] + len(lens) + 2 * (len(off) - 1), 32, np.uint8)
    out[np.arange(begin[-1]) + np.repeat(at - begin[:-1], lens)] = data[inside]
    out[begin[words[1:]] + words[1:] + 2 * np.arange(len(off) - 1) + 1] = 10
    return out, at, words


class WuManber:
    """Finds all occurrences of byte strings of similar length."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = 8 if self.m >= LONG else min(3, self.m)
        self.bits = 20 if self.m >= LONG else 16
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        self.head = np.uint64((1 << (8 * min(self.m, 8))) - 1)
        first = np.frombuffer(b"".join(p[: self.m].ljust(self.m + 8, b"\0") for p in patterns), np.uint8).reshape(len(patterns), -1)
        far = self.m - self.block
        self.shift = np.full(1 << self.bits, far + 1, np.int32)
        for j in range(far + 1):
            np.minimum.at(self.shift, self._hash(self._words(first[:, j : j + 8])), far - j)
        ends = self._hash(self._words(first[:, far : far + 8]))
        self.order = np.argsort(ends, kind="stable")
        self.bucket = ends[self.order]
        self.heads = self._words(first[:, :8]) & self.head

    @staticmethod
    def _words(rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view("<u8").ravel().astype(np.uint64)

    def _hash(self, block: np.ndarray) -> np.ndarray:
        return ((block & self.mask) * _MULT >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern index) of each occurrence."""
        n, none = len(text), np.zeros(0, np.int64)
        if n < self.m:
            return none, none
        padded = np.concatenate((text, np.zeros(8, np.uint8)))
        eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
        bounds = np.linspace(self.m, n + 1, max(1, n // STRETCH) + 1).astype(np.int64)
        cur, end, stops = bounds[:-1].copy(), bounds[1:], []
        while len(cur):
            step = self.shift[self._hash(eight[cur - self.block])]
            stops.append(cur[step == 0])
            cur = cur + np.maximum(step, 1)
            left = cur < end
            cur, end = cur[left], end[left]
        stop = np.concatenate(stops)
        hashes = self._hash(eight[stop - self.block])
        low, high = np.searchsorted(self.bucket, hashes), np.searchsorted(self.bucket, hashes, side="right")
        many = high - low
        where = np.repeat(stop - self.m, many)
        which = self.order[np.arange(many.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many)]
        same = (eight[where] & self.head) == self.heads[which]
        where, which, raw = where[same], which[same], text.tobytes()
        true = np.fromiter((raw.startswith(self.patterns[p], s) for s, p in zip(where.tolist(), which.tolist(), strict=True)), bool, len(where))
        return where[true], which[true]


class Windows:
    """The windows of some items, with the ids of the items that hold each."""

    def __init__(self, items: dict[bytes, set[str]]):
        self.ids = [sorted(x) for x in items.values()]
        groups: dict[bool, list[int]] = {}
        patterns = list(items)
        for i, p in enumerate(patterns):
            groups.setdefault(len(p) >= LONG, []).append(i)
        self.words = np.array([p.count(b" ") - 1 for p in patterns], np.int64)
        self.parts = [(np.array(g), WuManber([patterns[i] for i in g])) for g in groups.values()]

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [(s, g[p]) for g, matcher in self.parts for s, p in [matcher.find(text)]]
        return np.concatenate([s for s, _ in found]), np.concatenate([p for _, p in found])


def item_windows(text: str | None, window: int) -> list[bytes]:
    buf = np.frombuffer((text or "").encode(), np.uint8)
    flat, _, _ = spaced(buf, np.array([0, len(buf)]))
    words = flat.tobytes().split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))]


def shards(benchmark: DataFrame, id_col: str, text_col: str, window: int, limit: int) -> Iterator[dict[bytes, set[str]]]:
    """Items' windows in lots of about limit bytes (one larger item is a lot); nothing else of the benchmark is held."""
    lot, held = {}, 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        for w in item_windows(text, window):
            held += 0 if w in lot else len(w)
            lot.setdefault(w, set()).update(() if item is None else (item,))
        if held >= limit:
            yield lot
            lot, held = {}, 0
    if lot:
        yield lot


_HITS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _scan(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Per document (id, key, text): its words, and the merged word ranges that windows of the broadcast lot cover, with their items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value) if shared.value else None
        for batch in batches:
            for a, b, buf, off in chunks(batch.column(2)):
                flat, at, words = spaced(buf, off)
                starts, ends, items = [None] * (b - a), [None] * (b - a), [None] * (b - a)
                if windows:
                    where, which = windows.find(flat)
                    word = np.searchsorted(at, where + 1)
                    doc = np.searchsorted(words, word, side="right") - 1
                    cover = np.zeros(len(at) + 1, np.int64)
                    np.add.at(cover, word, 1)
                    np.add.at(cover, word + windows.words[which], -1)
                    hit = np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))
                    held: dict[int, set[str]] = {}
                    for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
                        held.setdefault(d, set()).update(windows.ids[p])
                    for d, ids in held.items():
                        own = np.concatenate(([False], hit[words[d] + 1 : words[d + 1] + 1], [False]))
                        edge = np.flatnonzero(own[1:] != own[:-1])
                        starts[d], ends[d], items[d] = edge[::2].tolist(), edge[1::2].tolist(), sorted(ids)
                yield batch_of(_HITS, batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), np.diff(words), starts, ends, items)

    return docs.mapInArrow(scan, "id long, key long, n_words long, starts array<long>, ends array<long>, items array<string>")


def _found(docs: DataFrame, lots: Iterator[dict[bytes, set[str]]], scratch: Scratch) -> DataFrame:
    """id, key, n_words, starts, ends and items of every row.

    One lot is searched as the result is read. Of several, each is searched by itself, its hits are written, and it leaves
    the executors before the next one comes; rows equal in id and text have the same hits.
    """
    context, lot = docs.sparkSession.sparkContext, next(lots, {})
    following = next(lots, None)
    if following is None:
        return _scan(docs, context.broadcast(lot))
    hits = None
    while lot is not None:
        shared = context.broadcast(lot)
        some = scratch.write(_scan(docs, shared).filter("items is not null").drop("id", "n_words").dropDuplicates(["key"]), "hits")
        shared.destroy()
        hits = some if hits is None else hits.unionByName(some)
        lot, following = following, next(lots, None) if following is not None else None
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return _scan(docs, context.broadcast({})).drop("starts", "ends", "items").join(hits.groupBy("key").agg(flat("starts"), flat("ends"), flat("items")), "key", "left")


def judged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """id, key (of the row), n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs.

    A word is hit if it lies in an occurrence of a window; contaminated means n_hit > 0 and 20 * n_hit >= n_words.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
    found = _found(own, shards(benchmark, item_col, item_text, window, pattern_bytes), Scratch(docs.sparkSession, "decontaminate"))
    none = F.array().cast("array<long>")
    spans = F.array_sort(F.arrays_zip(F.coalesce("starts", none).alias("s"), F.coalesce("ends", none).alias("e")))
    n_hit = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to")),
        lambda acc: acc["n"],
    )
    items = F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>"))))
    out = found.select("id", "key", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs; see judged()."""
    return judged(docs, benchmark, id_col, **options).drop("key").withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    bad = scratch.write(judged(docs, benchmark, id_col, text_col).filter("contaminated").select("key").distinct(), "bad")
    return without_keys(docs, bad, id_col, text_col)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op10_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
o AS (SELECT doc_id, i, k, item_id FROM dw JOIN p USING (k, s)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM o GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
}
