"""Language identification by interpolated Kneser-Ney character models, one a language (operator 12).

The n-grams of all learned documents are counted in Spark, exactly, per language; absolute discounting (one discount an order
and language, from how many n-grams occur once and twice) and continuation counts of the lower orders give each seen n-gram a
probability beside what is left for the next order. A model is stored as sorted arrays of hashes: for each order the hashes of
its n-grams with their probabilities, and those of the contexts with the weights of the order below. A hash has HASH_BITS
bits, so an order takes at most 2 ** HASH_BITS entries, however large the corpus; n-grams that share a hash share the mean of
their values by count. The languages are scored in lots whose arrays together stay under MODEL_BYTES (one language has at most
56 MB), so a broadcast has that bound; more languages take more passes and give the same result.

A text's symbols are its letters, lower-cased; anything between letters is one blank. The language with the lowest
cross-entropy a symbol is predicted (of equal ones the first by name). score is its posterior if each language's entropy
counted for EVIDENCE symbols. Rejection is calibrated by learned documents that the counts leave out (one in three): a
language's limit is the QUANTILE of the entropies of those of its own that are predicted right, in fixed bins, plus SLACK;
accepted says whether a text stays under it. A rejected text keeps its prediction.

Learned from: text and lang of documents with a text, a lang and an id whose crc32 modulo 4 isn't 2; of them 0 and 1 are counted
and 3 calibrates. A language without counted documents is counted from those with 3. Languages without calibrating documents
take the limit of all. lang, source and id have no part in a prediction.

Defined results: null texts and texts without a letter are `und` with score 0 and accepted false; without any learned document
all are `und`. A null id is not held out and not learned from. Repeated rows give a row each. Other columns are ignored,
whatever their names. A long text is taken apart in pieces of PIECE bytes that overlap by the context, so memory is bounded.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Scratch, batch_of, table, text_arrays
from llm.wordhash import mix

ORDER = 4
HASH_BITS = 20
MODEL_BYTES, ENTRY = 64 << 20, 8
PIECE = 1 << 18
EVIDENCE = 20
QUANTILE, SLACK, BINS = 0.995, 0.05, 1000
#: Distinct n-grams whose costs a worker keeps.
KEPT = 1 << 19
_BLANK, _FAR = 32, 0xFFFE


@functools.cache
def _symbols() -> np.ndarray:
    """Of each character of the basic plane: its lower case if it is a letter, else a blank."""
    out = np.full(1 << 16, _BLANK, np.uint16)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
    return out


def symbols(buf: np.ndarray) -> np.ndarray:
    """A symbol for each character of the UTF-8 bytes."""
    chars = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
    out = _symbols()[np.minimum(chars, 0xFFFF)]
    for c in np.unique(chars[chars > 0xFFFF]).tolist():
        out[chars == c] = _FAR if chr(c).isalpha() else _BLANK
    return out


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, end row, bytes, offsets, whether it goes on) of runs of rows, or of a part of one long row."""
    buf, off = text_arrays(column)
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + PIECE, side="right")) - 1)
        a, b = int(off[at]), int(off[end])
        while end == at + 1 and b - a > PIECE:
            cut = a + PIECE
            while buf[cut] & 0xC0 == 0x80:
                cut -= 1
            yield at, end, buf[a:cut], np.array([0, cut - a]), True
            a = cut
        yield at, end, buf[a:b], off[at : end + 1] - off[at] if a == off[at] else np.array([0, b - a]), False
        at = end


def grams(buf: np.ndarray, off: np.ndarray, order: int, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """16 bits for each symbol of each n-gram, last one lowest; the offsets of each text's n-grams; the last symbols.

    before: the order - 1 symbols that a single text's first ones follow; blanks by default.
    """
    s = symbols(buf)
    ends = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[off]
    letter = s != _BLANK
    follows = np.concatenate(([False], letter[:-1]))
    follows[ends[:-1][ends[:-1] < len(s)]] = before is not None and before[-1] != _BLANK
    kept = letter | follows
    n = np.diff(np.concatenate(([0], np.cumsum(kept)))[ends])
    s, pad, texts = s[kept], order - 1, len(off) - 1
    begin = np.cumsum(n) - n + np.arange(texts) * pad
    framed = np.full(len(s) + texts * pad, _BLANK, np.uint64)
    if before is not None:
        framed[:pad] = before
    framed[np.arange(len(s)) + np.repeat((np.arange(texts) + 1) * pad, n)] = s
    code = framed.copy()
    for i in range(1, order):
        code[i:] |= framed[:-i] << np.uint64(16 * i)
    valid = np.ones(len(framed), bool)
    for i in range(pad):
        valid[begin + i] = False
    return code[valid], np.concatenate(([0], np.cumsum(n))), framed[len(framed) - pad :]


def coded(column: pa.Array, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, n-grams, offsets) of all pieces of the texts; a long text comes in several."""
    before = None
    for a, b, buf, off, more in pieces(column):
        code, at, last = grams(buf, off, order, before)
        yield a, b, code, at
        before = last if more else None


def counted(docs: DataFrame, order: int) -> DataFrame:
    """language, gram, n; docs: language (a number) and text. Counts are added up inside tasks first."""
    schema = pa.schema([("language", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def total(language: int) -> tuple[np.ndarray, np.ndarray]:
            distinct, where = np.unique(np.concatenate([g for g, _ in held[language]]), return_inverse=True)
            return distinct, np.bincount(where, np.concatenate([c for _, c in held[language]])).astype(np.int64)

        for batch in batches:
            every = batch.column(0).to_numpy()
            for language in np.unique(every).tolist():
                for _, _, code, _ in coded(batch.column(1).filter(pa.array(every == language)), order):
                    held.setdefault(language, []).append(np.unique(code, return_counts=True))
                    if sum(len(g) for g, _ in held[language]) > 1_000_000:
                        held[language] = [total(language)]
            if sum(len(g) for own in held.values() for g, _ in own) > 4_000_000:
                for language in held:
                    g, n = total(language)
                    yield batch_of(schema, np.full(len(g), language, np.int32), g.view(np.int64), n)
                held = {}
        for language in held:
            g, n = total(language)
            yield batch_of(schema, np.full(len(g), language, np.int32), g.view(np.int64), n)

    rows = docs.mapInArrow(run, "language int, gram long, n long")
    return rows.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def hashed(code: np.ndarray, kind: int) -> np.ndarray:
    """HASH_BITS bits of n-grams or contexts; kind tells orders apart."""
    return (mix(code + np.uint64(0x9E37 * (kind + 1))) >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def low(code, symbols_: int):
    return code & np.uint64((1 << (16 * symbols_)) - 1)


def stored(counts: DataFrame, order: int, work: Scratch) -> DataFrame:
    """language, kind, key and value of the models: kind k - 1 holds n-grams of order k, order + k - 2 their contexts.

    The unigrams' context, the empty one, is kind 2 * order - 1; its value is what each symbol takes beside the counts.
    """
    schema = pa.schema([("language", pa.int32()), ("kind", pa.int32()), ("key", pa.int32()), ("value", pa.float64()), ("n", pa.int64())])

    def keys(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key = hashed(b.column(1).to_numpy().view(np.uint64), kind)
                yield batch_of(schema, b.column(0), np.full(b.num_rows, kind, np.int32), key, b.column(2), b.column(3))

        return run

    levels, found = {order: counts}, []
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("gram")
        levels[k] = work.write(levels[k + 1].groupBy("language", suffix).agg(F.count(F.lit(1)).alias("n")), f"order-{k}")
    for k in range(order, 0, -1):
        once = levels[k].groupBy("language").agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        discount = once.select("language", F.when(F.col("n1") * F.col("n2") > 0, y).otherwise(0.5).alias("d"))
        context = F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long")
        rows = levels[k].join(F.broadcast(discount), "language").withColumn("context", context)
        after = rows.groupBy("language", "context").agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"), F.first("d").alias("d")
        )
        if k == 1:  # one row a language: each symbol seen, and one unseen, shares what is left
            left = F.col("d") * F.col("types") / F.col("total") / (F.col("types") + 1)
            found.append(after.select("language", F.lit(2 * order - 1).alias("kind"), F.lit(0).alias("key"), left.alias("value"), F.col("total").alias("n")))
            after = F.broadcast(after)
        else:
            left = (F.col("d") * F.col("types") / F.col("total")).alias("value")
            found.append(after.select("language", "context", left, F.col("total").alias("n")).mapInArrow(keys(order + k - 2), _ENTRY))
        p = ((F.col("n") - F.col("d")) / F.col("total")).alias("value")
        rows = rows.drop("d").join(after, ["language", "context"]).select("language", "gram", p, "n")
        found.append(rows.mapInArrow(keys(k - 1), _ENTRY))
    every = functools.reduce(DataFrame.unionByName, found)
    mean = (F.sum(F.col("value") * F.col("n")) / F.sum("n")).cast("float").alias("value")
    return work.write(every.groupBy("language", "kind", "key").agg(mean), "model")


_ENTRY = "language int, kind int, key int, value double, n long"


def lots(model: DataFrame, languages: int) -> list[list[int]]:
    """The languages in lots of at most MODEL_BYTES of entries, or of one language; from counts, one a language."""
    size = {r["language"]: r["count"] * ENTRY for r in model.groupBy("language").count().collect()}
    out: list[list[int]] = []
    room = -1
    for i in range(languages):
        room -= size.get(i, 0)
        if room < 0:
            out.append([])
            room = MODEL_BYTES - size.get(i, 0)
        out[-1].append(i)
    return out


class Models:
    """Sorted arrays of hashes of some languages' models, and the costs of n-grams under each of them."""

    def __init__(self, entries: pa.Table, languages: list[int], order: int):
        language, kind, key, value = (entries[c].to_numpy() for c in ("language", "kind", "key", "value"))
        self.order, self.languages, self.arrays = order, languages, []
        for i in languages:
            own = []
            for k in range(2 * order):
                at = np.flatnonzero((language == i) & (kind == k))
                at = at[np.argsort(key[at])]
                own.append((key[at], value[at].astype(np.float32)))
            self.arrays.append(own)

    @staticmethod
    def _find(held: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        known, value = held
        if not len(known):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, value[at].astype(np.float64), missing)

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Negative logarithms of the probabilities of each n-gram's last symbol: a row a gram, a column a language."""
        order = self.order
        seen = [hashed(low(code, k), k - 1) for k in range(1, order + 1)]
        past = [hashed(low(code, k) >> np.uint64(16), order + k - 2) for k in range(2, order + 1)]
        out = np.empty((len(code), len(self.arrays)), np.float32)
        for j, own in enumerate(self.arrays):
            p = float(own[2 * order - 1][1][0]) + self._find(own[0], seen[0], 0.0)
            for k in range(2, order + 1):
                p = self._find(own[k - 1], seen[k - 1], 0.0) + self._find(own[order + k - 2], past[k - 2], 1.0) * p
            out[:, j] = -np.log(np.minimum(p, 1.0))
        return out


class Known:
    """Costs of the n-grams met so far, in a table of hashes; at most KEPT of them are kept."""

    def __init__(self, models: Models):
        self.models = models
        self._set(np.zeros(1, np.uint64), models.costs(np.zeros(1, np.uint64)))

    def _set(self, code: np.ndarray, cost: np.ndarray) -> None:
        self.code, self.cost, self.bits = code, cost, max(16, len(code).bit_length() + 2)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.at[self._place(code)] = np.arange(len(code), dtype=np.int32)

    def _place(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        at = self.at[self._place(code)]
        other = np.flatnonzero(self.code[at] != code)
        if not len(other):
            return self.cost[at]
        out = self.cost[at]
        new, back = np.unique(code[other], return_inverse=True)
        cost = self.models.costs(new)
        out[other] = cost[back]
        lost = ~np.isin(new, self.code) if len(self.code) < KEPT else np.ones(len(new), bool)
        if lost.any():
            keep = slice(None) if len(self.code) < KEPT else slice(0, 0)
            self._set(np.concatenate((self.code[keep], new[lost])), np.concatenate((self.cost[keep], cost[lost])))
        return out


def scored(rows: DataFrame, entries: pa.Table, languages: list[int], order: int, first: bool) -> DataFrame:
    """rows (and text, their first column) with n, and the best and the sum of posteriors so far by these languages too."""
    shared = rows.sparkSession.sparkContext.broadcast((entries, languages))
    names = [f.name for f in rows.schema if first or f.name not in ("n", "best", "entropy", "mass")]
    schema = rows.select(*names).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", n long, best int, entropy double, mass double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(Models(*shared.value, order))
        tags = np.array(shared.value[1], np.int32)
        for batch in batches:
            texts = batch.column(0)
            cost, n = np.zeros((len(texts), len(tags))), np.zeros(len(texts), np.int64)
            for a, b, code, off in coded(texts, order):
                some = np.flatnonzero(np.diff(off))
                if len(some):
                    cost[a + some] += np.add.reduceat(known(code), off[some], axis=0, dtype=np.float64)
                    n[a:b] += np.diff(off)
            entropy = cost / np.maximum(n, 1)[:, None]
            place = entropy.argmin(1)
            best, least = tags[place], entropy[np.arange(len(n)), place]
            mass = np.exp(EVIDENCE * (least[:, None] - entropy)).sum(1)
            if not first:
                old, was, had = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("best", "entropy", "mass"))
                top = np.minimum(was, least)
                mass = had * np.exp(EVIDENCE * (top - was)) + mass * np.exp(EVIDENCE * (top - least))
                best, least = np.where(was <= least, old, best), top
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(n), pa.array(best, pa.int32()), pa.array(least), pa.array(mass)],
                names=[*names, "n", "best", "entropy", "mass"],
            )

    return rows.mapInArrow(run, out)


def limits(rows: DataFrame) -> DataFrame:
    """best and limit: for each language, and for null all of them together, the quantile of counts in fixed bins."""
    bins = rows.groupBy("best", F.floor(F.col("entropy") * BINS).alias("bin")).count()
    bins = bins.unionByName(bins.groupBy("bin").agg(F.sum("count").alias("count")).withColumn("best", F.lit(None).cast("int")))
    h = bins.groupBy("best").agg(F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("h"), F.sum("count").alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["count"]
        return F.struct(seen.alias("seen"), F.coalesce(acc["bin"], F.when(seen >= F.ceil(QUANTILE * F.col("n")), x["bin"])).alias("bin"))

    return h.select("best", (F.aggregate("h", start, step, lambda acc: acc["bin"] + 1) / BINS + SLACK).alias("limit"))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """id_col, held_out, lang_pred, score, accepted, n_symbols, entropy and limit (of the predicted language) of every row.

    The distinct languages and their figures are gathered on the driver: a row a language.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "language-id")
    own = docs.select(
        F.col(f"`{text_col}`").alias("text"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.coalesce(remainder(F.col(f"`{id_col}`")), F.lit(-1)).cast("int").alias("part"),
    )
    learned = own.filter("part in (0, 1, 3) and lang is not null and text is not null")
    found = learned.groupBy("lang").agg(F.max(F.col("part") < 3).alias("counted")).orderBy("lang").collect()
    names = [r["lang"] for r in found]
    number = F.coalesce(*[F.when(F.col("lang") == v, i) for i, v in enumerate(names)], F.lit(-1)).cast("int")
    spare = [r["lang"] for r in found if not r["counted"]]
    train = learned.filter((F.col("part") < 3) | F.col("lang").isin(spare)) if spare else learned.filter("part < 3")
    counts = work.write(counted(train.select(number.alias("language"), "text"), order), "counts")
    model = stored(counts, order, work)
    rows, first = own.select("text", "id", "part", number.alias("language")), True
    able = {r["language"] for r in model.select("language").distinct().collect()}
    for lot in lots(model.filter(F.col("language").isin(sorted(able))), len(names)):
        lot = [i for i in lot if i in able]  # a language without a letter has no model
        if lot:
            rows = rows if first else work.write(rows, "lot")
            rows, first = scored(rows, model.filter(F.col("language").isin(lot)).toArrow(), lot, order, first), False
    if first:
        rows = rows.select("id", "part", "language", *[F.lit(v).cast(t).alias(c) for c, v, t in (("n", 0, "long"), ("best", None, "int"), ("entropy", None, "double"), ("mass", None, "double"))])
    rows = work.write(rows.drop("text"), "scored")
    work.drop("counts", "model", "lot", *[f"order-{k}" for k in range(1, order)])
    some = (F.col("n") > 0) & F.col("best").isNotNull()
    right = rows.filter(some & (F.col("part") == 3) & (F.col("best") == F.col("language")))
    of = {r["best"]: r["limit"] for r in limits(right).collect()}
    names_ = F.coalesce(*[F.when(F.col("best") == i, F.lit(v)) for i, v in enumerate(names)], F.lit("und"))
    limit = F.coalesce(*[F.when(F.col("best") == i, F.lit(of.get(i, of.get(None)))) for i in range(len(names))], F.lit(None).cast("double"))
    return rows.select(
        F.col("id").alias(id_col),
        (F.col("part") == 2).alias("held_out"),
        F.when(some, names_).otherwise("und").alias("lang_pred"),
        F.when(some, F.round(1 / F.col("mass"), 6)).otherwise(0.0).alias("score"),
        F.when(some, F.coalesce(F.col("entropy") <= limit, F.lit(True))).otherwise(F.lit(False)).alias("accepted"),
        F.col("n").alias("n_symbols"),
        F.when(some, F.round("entropy", 6)).alias("entropy"),
        F.when(some, F.round(limit, 6)).alias("entropy_limit"),
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
