"""Quality classifier: perplexity under an interpolated modified Kneser-Ney character n-gram model (operator 2).

The model counts the n-grams of documents labelled good. Documents are scored in blocks: each block asks for its
distinct n-grams, the requests are joined with the sharded counts of every order, and the answers come back to the block,
where each document adds up its own. Half of the good documents (by a hash of the id) train the model and the other half,
which it hasn't seen, sets the limits: a language's is a quantile of the perplexities of its own held-out documents, from
counts in fixed bins, and SLACK, however many these are. A document above it is rejected. Languages without such documents take the limit of all of them.

Characters: digits count as one, blanks as a space, those beyond the basic plane as one. Each text is framed by ORDER - 1
start marks and an end mark. Perplexities are smoothed by PRIOR characters of the mean cost, as short texts tell little.

Defined results: a null or empty text is its end mark alone; null languages are a language of their own; repeated rows
and ids give a row each; with no good documents at all nothing is rejected; rows are rejected one by one, whatever their
ids. Other columns are ignored, whatever their names.
Blocks are formed twice, for requests and for answers, so rows must come in the same order twice. Files do; what comes of
anything else is written to a table first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Scratch, batch_of, by_ids, chunks, row_key, table, text_arrays, with_ids, without_keys

ORDER = 4
QUANTILE, SLACK = 0.995, 0.03
PRIOR = 100
#: Bins of a nat: costs a character are counted in steps of 1 / BINS.
BINS = 1000
#: Bytes of text in a block.
BLOCK_BYTES = 12 << 20
_START, _END, _BEYOND = 1, 2, 0xFFFE


def codes(buf: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """16 bits for each character of each n-gram, last character lowest, and the offsets of each text's n-grams."""
    chars = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    off = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[off]
    chars[(chars >= 48) & (chars <= 57)] = 48
    chars[(chars >= 9) & (chars <= 13)] = 32
    chars[chars > 0xFFFF] = _BEYOND
    n, docs = np.diff(off), len(off) - 1
    begin = off[:-1] + np.arange(docs) * order
    s = np.full(len(chars) + docs * order, _START, np.uint64)
    s[np.arange(len(chars)) + np.repeat(begin + order - 1 - off[:-1], n)] = chars
    s[begin + n + order - 1] = _END
    code = s.copy()
    for i in range(1, order):
        code[i:] |= s[:-i] << np.uint64(16 * i)
    valid = np.ones(len(s), bool)
    for i in range(order - 1):
        valid[begin + i] = False
    return code[valid], np.concatenate(([0], np.cumsum(n + 1)))


def blocks(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[tuple[int, list[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]]]:
    """(number, parts) of blocks, each of as few rows as have limit bytes (the last has fewer), wherever batches end."""
    parts, size, number = [], 0, TaskContext.get().partitionId() << 24
    for batch in batches:
        column, at = batch.column(text), 0
        off = text_arrays(column)[1]
        while at < len(column):
            end = min(len(column), max(at + 1, int(np.searchsorted(off, off[at] + limit - size))))
            parts += [(batch, at + a, at + b, buf, own) for a, b, buf, own in chunks(column.slice(at, end - at))]
            size += int(off[end] - off[at])
            at = end
            if size >= limit:
                yield number, parts
                parts, size, number = [], 0, number + 1
    if parts:
        yield number, parts


def _distinct(parts: list, order: int) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(codes(buf, off, order)[0]) for _, _, _, buf, off in parts]))


def counted(docs: DataFrame, order: int) -> DataFrame:
    """gram, n: how often the n-grams occur, added up inside tasks."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            grams, where = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            return grams, np.bincount(where, np.concatenate([c for _, c in held])).astype(np.int64)

        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0)):
                held.append(np.unique(codes(buf, off, order)[0], return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [total()]
                    if (size := len(held[0][0])) > 1_000_000:
                        yield batch_of(schema, held[0][0].view(np.int64), held[0][1])
                        held, size = [], 0
        if held:
            grams, n = total()
            yield batch_of(schema, grams.view(np.int64), n)

    return docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _low(gram: Column, chars: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (16 * chars)) - 1))


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from how many n-grams occur once to four times; 0.75 where the counts can't tell."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[0] else 0.75 for k in (1, 2, 3)]
    return [min(max(d, 0.0), float(k)) if d > 0 else 0.75 for k, d in zip((1, 2, 3), raw, strict=True)]


def probabilities(grams: DataFrame, counts: DataFrame, order: int, work: Scratch) -> DataFrame:
    """gram and cost (negative log of its last character's probability after the others) of the distinct grams."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):  # lower orders count the different characters before
        levels[k] = work.write(levels[k + 1].groupBy(_low(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"order-{k}")
    lower = None
    for k in range(1, order + 1):
        row = levels[k].agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count(F.lit(1)).alias("types")).first()
        d = discounts([row[f"n{i}"] for i in (1, 2, 3, 4)])
        off = lambda n: F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])  # noqa: E731, B023
        context = F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long")
        after = levels[k].groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(off(F.col("n"))).alias("left"))
        asked = grams.select(_low(F.col("gram"), k).alias("gram")).distinct() if k < order else grams.select("gram")
        asked = asked.join(levels[k], "gram", "left").withColumn("context", context)
        asked = asked.join(F.broadcast(after) if k == 1 else after, "context", "left")
        if lower is None:
            asked = asked.withColumn("below", F.lit(1.0 / (row["types"] + 1)))
        else:
            asked = asked.withColumn("low", _low(F.col("gram"), k - 1)).join(lower.select(F.col("gram").alias("low"), F.col("p").alias("below")), "low")
        seen = F.when(F.col("n").isNotNull(), F.greatest(F.col("n") - off(F.col("n")), F.lit(0.0)) / F.col("total")).otherwise(0.0)
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise(seen + F.col("left") / F.col("total") * F.col("below"))
        lower = work.write(asked.select("gram", p.alias("p")), f"p-{k}")
    return lower.select("gram", (-F.log("p")).cast("float").alias("cost"))


def requests(docs: DataFrame, order: int, limit: int) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), ("gram", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in blocks(batches, 0, limit):
            grams = _distinct(parts, order).view(np.int64)
            yield batch_of(schema, np.full(len(grams), number), grams)

    return docs.mapInArrow(run, "block long, gram long")


_PACKED = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("text", pa.binary())])


def packed(docs: DataFrame, limit: int) -> DataFrame:
    """The blocks' texts, compressed, in parts of a chunk each. Columns: text, id, key, lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in blocks(batches, 0, limit):
            for i, (batch, a, b, buf, off) in enumerate(parts):
                yield batch_of(_PACKED, [number], [i], *[[batch.column(c).slice(a, b - a).to_pylist()] for c in (1, 2, 3)], [np.diff(off).tolist()], [zlib.compress(buf.tobytes(), 6)])

    return docs.mapInArrow(run, "block long, part int, ids array<long>, keys array<long>, langs array<string>, sizes array<long>, text binary")


class Costs:
    """Looks up the costs of n-grams: a table of hashes, and a search for the few that share a place there."""

    def __init__(self, grams: np.ndarray, cost: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.cost = grams[order], cost[order].astype(np.float64)
        self.bits = max(16, int(len(grams)).bit_length() + 4)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.at[self._hash(self.grams)] = np.arange(len(grams), dtype=np.int32)

    def _hash(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        at = self.at[self._hash(g)]
        other = np.flatnonzero(self.grams[at] != g)
        if len(other):
            at[other] = np.minimum(np.searchsorted(self.grams, g[other]), len(self.grams) - 1)
            if (self.grams[at[other]] != g[other]).any():
                raise ValueError("the documents were read in another order than before; write them to a table first")
        return self.cost[at]


def scored(docs: DataFrame, answers: DataFrame, order: int, limit: int) -> DataFrame:
    """id, key, lang, n_grams and cost (the sum) of each row."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("lang", pa.string()), ("n_grams", pa.int64()), ("cost", pa.float64())])

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows:
            costs = Costs(own["gram"].to_numpy().view(np.uint64), own["cost"].to_numpy())
            for i in range(texts.num_rows):
                sizes = np.array(texts["sizes"][i].as_py(), np.int64)
                code, off = codes(np.frombuffer(zlib.decompress(texts["text"][i].as_py()), np.uint8), np.concatenate(([0], np.cumsum(sizes))), order)
                out.append(pa.RecordBatch.from_arrays([texts["ids"][i].values, texts["keys"][i].values, texts["langs"][i].values, pa.array(np.diff(off)), pa.array(np.add.reduceat(costs(code), off[:-1]))], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return packed(docs, limit).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "id long, key long, lang string, n_grams long, cost double")


def read_alike(df: DataFrame) -> bool:
    """Whether df only selects and filters rows of files or of the driver's own, which come in the same order each time."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        children = plan.children()
        if children.size() and plan.nodeName() not in ("Project", "Filter"):
            return False
        todo += [children.apply(i) for i in range(children.size())]
    return True


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, key (of the row), lang, n_grams, perplexity, limit (of the language) and kept for every row of docs.

    labels has id_col and quality; documents with quality 1 are good. All of them are used, for training or for the limits.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "quality-lm")
    own = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"))
    own = own if read_alike(own) else work.write(own, "documents")
    good = work.write(with_ids(labels, id_col, "quality").filter("quality = 1").select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("held", F.pmod(F.xxhash64("id"), F.lit(2)) == 1), "good")
    counts = work.write(counted(by_ids(own, good.filter("not held").select("id"), "id").select("text"), order), "counts")
    asked = requests(own.select("text"), order, block_bytes)
    costs = probabilities(work.write(asked.select("gram").distinct(), "grams"), counts, order, work)
    rows = work.write(scored(own, asked.join(costs, "gram").select("block", "gram", "cost"), order, block_bytes), "scored")
    work.drop("counts", "grams", *[f"order-{k}" for k in range(1, order)], *[f"p-{k}" for k in range(1, order)])
    trusted = rows.join(good.filter("held"), "id", "left_semi")
    mean = trusted.groupBy("lang").agg(F.sum("cost").alias("cost"), F.sum("n_grams").alias("n"))
    mean = work.write(mean, "mean")
    every = mean.agg(F.sum("cost").alias("cost"), F.sum("n").alias("n")).first()
    overall = (every["cost"] / every["n"]) if every["n"] else 0.0
    smooth = lambda df: df.join(mean.select("lang", (F.col("cost") / F.col("n")).alias("mean")), "lang", "left").withColumn("nats", (F.col("cost") + PRIOR * F.coalesce("mean", F.lit(overall))) / (F.col("n_grams") + PRIOR))
    bins = smooth(trusted).groupBy("lang", F.floor(F.col("nats") * BINS).alias("bin")).count()
    bins = work.write(bins, "bins")

    def limits(by: DataFrame) -> DataFrame:
        h = by.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("h"), F.sum("count").alias("n"))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))
        reach = lambda acc, x: F.coalesce(acc["bin"], F.when(acc["seen"] + x["count"] >= F.ceil(F.lit(quantile) * F.col("n")), x["bin"]))
        bin_ = F.aggregate("h", start, lambda acc, x: F.struct((acc["seen"] + x["count"]).alias("seen"), reach(acc, x).alias("bin")), lambda acc: acc["bin"])
        return h.select("lang", ((bin_ + 1) / BINS + slack).alias("limit"))

    own_limits = work.write(limits(bins), "limits")
    whole = limits(bins.groupBy(F.lit("").alias("lang"), "bin").agg(F.sum("count").alias("count"))).first()
    out = smooth(rows).join(own_limits, "lang", "left").withColumn("limit", F.coalesce("limit", F.lit(whole["limit"] if whole else None).cast("double")))
    return out.select("id", "key", "lang", "n_grams", F.round(F.exp("nats"), 6).alias("perplexity"), F.round(F.exp("limit"), 6).alias("limit"), F.coalesce(F.col("nats") <= F.col("limit"), F.lit(True)).alias("kept"))


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id_col, lang, n_grams, perplexity, limit (of the language) and kept for every row of docs; see judged()."""
    return judged(docs, labels, id_col, **options).drop("key").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    work = Scratch(docs.sparkSession, "quality-lm-filter")
    bad = judged(docs, labels, id_col, text_col, lang_col).filter("not kept").select("key").distinct()
    return without_keys(docs, work.write(bad, "rejected"), id_col, text_col)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
