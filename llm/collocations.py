"""Phrase collocation mining: phrases of two and three words that hold together, per language (operator 13).

Level by level: words, pairs of frequent words, triples whose two pairs are frequent. Each level's map tasks sum the hashed
phrases that may be frequent and the sums are joined by hash, so what stays is a superset of the frequent phrases: the
candidates. These are split by hash into shards of about SHARD, and each shard gets a minimal perfect hash function: bits of
the places that one key alone takes, level by level, and the rank of a key's bit is its slot; the keys stand in the order of
their slots. The texts' map tasks then send candidates with counts to the shards, where bounded numbers of them are looked up,
compared with the stored key (all else is dropped), and added up with bincount into an array over the slots; these arrays are
summed in a tree of fan-in FAN. A candidate's words come from the first task that has met it. Cuts ask the shards of their
parts and read l and r by slot.

Neither candidates nor counts are ever broadcast: only Bits (8 MB) are, for a first test in map tasks. Phrases are told apart
by 64-bit hashes over language and words: two of n share one with a chance of about n * n / 2 ** 65. Scores are exact for
counts up to 10 ** 16.

Defined results: a null text has no words, a null language is `und`; repeated rows count each; an empty table gives no rows;
other columns are ignored, whatever their names. A text longer than CHUNK_BYTES is cut behind a mark at which phrases end
anyway; only a text without such marks for longer than that is taken whole up to the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import CHUNK_BYTES, Bits, Scratch, batch_of, by_ids, table, text_arrays
from llm.wordhash import BYTE, LOWER, mix, span_hashes, windows, word_bounds

MIN_COUNT, TOP, HALF_PERCENT = 10, 2000, 50
#: Candidates of a shard, about; rows of 64-bit numbers that a task looks up at once; arrays summed by one task.
SHARD, ASKED, FAN = 1 << 16, 1 << 20, 16
#: Distinct phrases that a map task holds before it sends them on.
HELD = 1 << 20
#: Groups in which each language's first rows are found before they meet.
GROUPS = 16
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _MARK.copy()
_GAP[[32, 9]] = True


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows, or of a part of one long row that ends behind a mark."""
    buf, off = text_arrays(column)
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK_BYTES, side="right")) - 1)
        a, b, own = int(off[at]), int(off[end]), off[at : end + 1] - off[at]
        while end == at + 1 and b - a > CHUNK_BYTES:
            marks = np.flatnonzero(_MARK[buf[a : a + CHUNK_BYTES]])
            cut = a + int(marks[-1]) + 1 if len(marks) else b
            if not len(marks):
                later = np.flatnonzero(_MARK[buf[a + CHUNK_BYTES : b]])
                cut = a + CHUNK_BYTES + int(later[0]) + 1 if len(later) else b
            if cut == b:
                break
            yield at, end, buf[a:cut], np.array([0, cut - a])
            a, own = cut, np.array([0, b - cut])
        yield at, end, buf[a:b], own
        at = end


class Words:
    """The words of some texts: keys (by language and word), and which of them begin a phrase of k words within a piece."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, salts: np.ndarray):
        self.data = LOWER[buf]
        self.starts, self.ends, at, _ = word_bounds(self.data, off, _GAP)
        text = np.repeat(np.arange(len(off) - 1), np.diff(at))
        self.salt = salts[text]
        self.key = mix(span_hashes(BYTE[self.data], self.starts, self.ends) ^ self.salt)
        self.piece = np.cumsum(_MARK[self.data])[self.starts] + text

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of k words begin, and their keys."""
        if k == 1:
            return np.arange(len(self.key)), self.key
        begin = np.flatnonzero(self.piece[k - 1 :] == self.piece[: len(self.piece) - k + 1])
        return begin, windows(self.key, k)[begin]


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The keys of pairs of words by the words' keys."""
    return windows(np.stack((a, b), 1).ravel(), 2)[::2] if len(a) else np.zeros(0, np.uint64)


class Sums:
    """Keys with counts and other columns of their first occurrence, summed as they grow."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, key: np.ndarray, *columns: np.ndarray) -> None:
        distinct, first, n = np.unique(key, return_index=True, return_counts=True)
        self.held.append((distinct, n, *[c[first] for c in columns]))
        self.size += len(distinct)
        if self.size > 2 * HELD:
            self.held = [self.total()]
            self.size = len(self.held[0][0])

    def full(self) -> bool:
        return self.size > HELD

    def total(self) -> tuple[np.ndarray, ...]:
        key, n, *columns = (np.concatenate(x) for x in zip(*self.held, strict=True))
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        return (distinct, np.bincount(back, n, len(distinct)).astype(np.int64), *[c[first] for c in columns])

    def take(self) -> tuple[np.ndarray, ...] | None:
        out = self.total() if self.held else None
        self.held, self.size = [], 0
        return out


def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """batches: text and salt."""
    for batch in batches:
        salts = batch.column(1).to_numpy().view(np.uint64)
        for a, b, buf, off in pieces(batch.column(0)):
            yield Words(buf, off, salts[a:b])


def mined(texts: DataFrame, k: int, lower: DataFrame | None) -> DataFrame:
    """key and n of all phrases of k words whose parts of k - 1 words may be in lower (column key).

    With the salt of words, and of longer phrases the first task that has met them.
    """
    test = Bits(lower, "key").test() if lower is not None else None
    names = ["key", "n", "salt" if k == 1 else "task"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, task = Sums(), TaskContext.get().partitionId()

        def sent() -> Iterator[pa.RecordBatch]:
            if (all_ := sums.take()) is not None:
                rest = [] if k == 1 else [np.full(len(all_[0]), task)]
                yield batch_of(schema, *[x.view(np.int64) for x in (*all_, *rest)])

        for w in words_of(batches):
            begin, key = w.phrases(k)
            if test is not None:
                where, part = w.phrases(k - 1)
                may = np.zeros(len(w.key) + 1, bool)
                may[where] = test(part)
                good = may[begin] & may[begin + 1]
                begin, key = begin[good], key[good]
            sums.add(key, *([w.salt[begin]] if k == 1 else []))
            if sums.full():
                yield from sent()
        yield from sent()

    rows = texts.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    if k == 1:
        return rows.groupBy("key", "salt").agg(F.sum("n").alias("n"))
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("task").alias("task"))


#: Bits by which a task's number is moved before it is mixed into a key.
_TASK = 44


class Slots:
    """A minimal perfect hash function over a shard's keys; the keys themselves stand in slot order.

    Each level has twice as many bits as keys are left; a key that is alone at its place there sets the bit, the others go
    on to the next level. A key's slot is the number of set bits before its own.
    """

    def __init__(self, bits: np.ndarray, sizes: list[int], keys: np.ndarray | None = None):
        self.bits, self.sizes, self.keys = bits, sizes, keys
        self.rank = np.cumsum(bits) - bits

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x51ED * (level + 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> Slots:
        """keys are distinct."""
        bits, sizes, left = [], [], keys
        while len(left):
            sizes.append(max(2 * len(left), 64))
            at = cls._place(left, len(sizes) - 1, sizes[-1])
            alone = np.bincount(at, minlength=sizes[-1]) == 1
            bits.append(alone)
            left = left[~alone[at]]
        out = cls(np.concatenate([np.zeros(0, bool), *bits]), sizes)
        out.keys = np.empty_like(keys)
        out.keys[out._slots(keys)] = keys
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, left, off = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = off + self._place(keys[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, off = left[~hit], off + size
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slots; -1 for keys that aren't the one stored there."""
        out = self._slots(keys)
        if len(self.keys):
            out[self.keys[np.maximum(out, 0)] != keys] = -1
        return out


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _array(x: pa.Scalar, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(x.as_py(), kind)


_MODEL = pa.schema([("shard", pa.int64()), ("bits", pa.binary()), ("sizes", pa.list_(pa.int64())), ("keys", pa.binary())])


def shard_of(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("key"), 64 - bits) if bits else F.lit(0).cast("long")


def functions(candidates: DataFrame, bits: int) -> DataFrame:
    """A row for each shard of the distinct candidates: its perfect hash function and the keys in slot order."""

    def build(part: pa.Table) -> pa.Table:
        keys = part["key"].to_numpy().view(np.uint64)
        own = Slots.build(keys)
        row = [[part["shard"][0].as_py()], [_bytes(np.packbits(own.bits))], [own.sizes], [_bytes(own.keys)]]
        return pa.table(row, schema=_MODEL)

    rows = candidates.select(shard_of(bits).alias("shard"), "key")
    return rows.groupBy("shard").applyInArrow(build, "shard long, bits binary, sizes array<long>, keys binary")


def loaded(model: pa.Table) -> Slots:
    sizes = model["sizes"][0].as_py()
    bits = np.unpackbits(_array(model["bits"][0], np.uint8), count=sum(sizes)).astype(bool)
    return Slots(bits, sizes, _array(model["keys"][0]))


def sent_counts(texts: DataFrame, candidates: DataFrame, bits: int, all_send: bool = False) -> DataFrame:
    """shard, row (a number of its own), and arrays of keys met that may be candidates, with their counts or with their words.

    A map task sends counts once they fill its memory and at its end, and the words of a key when it first meets it, if it is
    the task that the candidates name for the key (all_send: every task does).
    """
    test = Bits(candidates, "key").test()
    named = candidates.select(F.col("key").bitwiseXOR(F.shiftleft("task", _TASK)).alias("key"))
    mine = None if all_send else Bits(named, "key").test()
    schema = pa.schema([("shard", pa.int64()), ("row", pa.int64()), *[(c, pa.binary()) for c in ("key", "n", "words")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, row, seen = Sums(), TaskContext.get().partitionId() << 32, np.zeros(0, np.uint64)

        def dealt(key: np.ndarray, n: np.ndarray | None, words: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            """One row a shard; keys are sorted."""
            nonlocal row
            if not len(key):
                return
            shard = key >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)
            cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
                yield batch_of(schema, [int(shard[a])], [row], [_bytes(key[a:b])], [_bytes(n[a:b]) if n is not None else b""], [_bytes(words[:, a:b]) if words is not None else b""])
                row += 1

        def sent() -> Iterator[pa.RecordBatch]:
            if (all_ := sums.take()) is not None:
                yield from dealt(all_[0], all_[1].astype(np.int64), None)

        def met(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            nonlocal seen
            key, first = np.unique(np.concatenate([k for k, _ in held]), return_index=True)
            words = np.concatenate([x for _, x in held], axis=1)[:, first]
            yield from dealt(key, None, words)
            seen = np.union1d(seen if len(seen) < 4 * HELD else seen[:0], key)

        new, size = [], 0
        for w in words_of(batches):
            for k in (1, 2, 3):
                begin, key = w.phrases(k)
                may = test(key)
                begin, key = begin[may], key[may]
                sums.add(key)
                if k > 1:
                    key, first = np.unique(key, return_index=True)
                    at = np.minimum(np.searchsorted(seen, key), max(len(seen) - 1, 0))
                    fresh = seen[at] != key if len(seen) else np.ones(len(key), bool)
                    if mine is not None:
                        fresh &= mine(key ^ np.uint64(TaskContext.get().partitionId() << _TASK))
                    key, begin = key[fresh], begin[first[fresh]]
                    new.append((key, np.stack([w.salt[begin], *[w.key[begin + i] if i < k else np.zeros(len(key), np.uint64) for i in range(3)]])))
                    size += len(key)
            if size > HELD // 4:
                yield from met(new)
                new, size = [], 0
            if sums.full():
                yield from sent()
        if size:
            yield from met(new)
        yield from sent()

    return texts.mapInArrow(run, "shard long, row long, key binary, n binary, words binary")


def with_copies(model: DataFrame, groups: DataFrame) -> DataFrame:
    """The model's rows, one for each group that asks a shard (groups: shard and its number of groups)."""
    rows = model.join(groups, "shard")
    return rows.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")


def added_up(sent: DataFrame, model: DataFrame, most: int) -> DataFrame:
    """shard, and arrays over its slots: n (counts) and words (salt and the keys of up to three words).

    most: groups that a shard's rows are dealt to.
    """
    groups = model.select("shard", F.lit(most).cast("long").alias("groups"))
    out = "shard long, group long, n binary, words binary"
    schema = pa.schema([("shard", pa.int64()), ("group", pa.int64()), ("n", pa.binary()), ("words", pa.binary())])

    def count(key: tuple, rows: pa.Table, own: pa.Table) -> pa.Table:
        slots = loaded(own)
        total, words = np.zeros(len(slots.keys), np.int64), np.zeros((4, len(slots.keys)), np.uint64)
        for i in range(rows.num_rows):
            at = slots(_array(rows["key"][i]))
            true = at >= 0
            if len(n := _array(rows["n"][i], np.int64)):
                total += np.bincount(at[true], n[true], len(total)).astype(np.int64)
            else:
                words[:, at[true]] = _array(rows["words"][i]).reshape(4, -1)[:, true]
        return pa.table([[key[0].as_py()], [key[1].as_py()], [_bytes(total)], [_bytes(words)]], schema=schema)

    def summed(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(_array(x, np.int64) for x in rows["n"])
        words = np.maximum.reduce([_array(x) for x in rows["words"]])
        return pa.table([[key[0].as_py()], [key[1].as_py()], [_bytes(total)], [_bytes(words)]], schema=schema)

    dealt = sent.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(most)))
    rows = dealt.groupBy("shard", "group").cogroup(with_copies(model, groups).groupBy("shard", "group")).applyInArrow(count, out)
    while most > 1:
        rows = rows.withColumn("group", F.floor(F.col("group") / FAN)).groupBy("shard", "group").applyInArrow(summed, out)
        most = -(-most // FAN)
    return rows.drop("group")


def counted_rows(model: DataFrame, counts: DataFrame) -> DataFrame:
    """key, a, salt, words, w1 to w3, left and right (the keys of the pairs inside) of candidates with MIN_COUNT or more."""
    names = ("key", "a", "salt", "words", "w1", "w2", "w3", "left", "right")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, a = _array(batch.column(0)[i]), _array(batch.column(1)[i], np.int64)
                salt, *w = _array(batch.column(2)[i]).reshape(4, -1)
                many = a >= MIN_COUNT
                key, a, salt, w1, w2, w3 = (x[many] for x in (key, a, salt, *w))
                words = 1 + (w2 != 0).astype(np.int64) + (w3 != 0)  # a single word has no entry at all
                yield batch_of(schema, key.view(np.int64), a, salt.view(np.int64), words, *[x.view(np.int64) for x in (w1, w2, w3, pair(w1, w2), pair(w2, w3))])

    rows = model.join(counts, "shard").select("keys", "n", "words")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def read_by_slot(asked: DataFrame, model: DataFrame, counts: DataFrame, bits: int, work: Scratch) -> DataFrame:
    """asked (key, owner, place) with f: the count at the key's slot."""
    asked = work.write(asked.withColumn("shard", shard_of(bits)), "asked")
    groups = work.write(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("groups")), "asked-groups")
    schema = pa.schema([("owner", pa.int64()), ("place", pa.int32()), ("f", pa.int64())])

    def read(rows: pa.Table, own: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        at = loaded(own)(rows["key"].to_numpy().view(np.uint64))
        f = _array(own["n"][0], np.int64)[at]
        if (at < 0).any():
            raise ValueError("a part of a frequent phrase isn't a candidate; was the input read the same way each time?")
        return pa.table([rows["owner"].combine_chunks(), rows["place"].combine_chunks(), pa.array(f)], schema=schema)

    dealt = asked.join(groups, "shard").withColumn("group", F.pmod(F.xxhash64("owner"), F.col("groups"))).drop("groups")
    held = with_copies(model.join(counts.select("shard", "n"), "shard"), groups)
    return dealt.groupBy("shard", "group").cogroup(held.groupBy("shard", "group")).applyInArrow(read, "owner long, place int, f long")


def first_rows(df: DataFrame, by: str, order: list[Column], top: int, rank) -> DataFrame:
    """The rows of each value of by within the first top by rank: first of GROUPS parts of it, then of what these leave."""
    part = F.pmod(F.xxhash64("key"), F.lit(GROUPS))
    few = df.withColumn("part", part).withColumn("rank", rank().over(Window.partitionBy(by, "part").orderBy(*order)))
    few = few.filter(F.col("rank") <= top).drop("rank", "part")
    return few.withColumn("rank", rank().over(Window.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def best_scores(df: DataFrame, top: int, work: Scratch) -> DataFrame:
    """Rows that may be among each salt's first top by score: all from the thousandth of the scale on that holds that many."""
    step = F.floor(F.col("score") / 1000)
    bins = work.write(df.groupBy("salt", step.alias("bin")).count(), "bins")
    above = F.sum("count").over(Window.partitionBy("salt").orderBy(F.col("bin").desc()))
    least = bins.withColumn("above", above - F.col("count")).filter(F.col("above") < top).groupBy("salt").agg(F.min("bin").alias("least"))
    return by_ids(df, work.write(least, "least"), "salt", "inner").filter(step >= F.col("least")).drop("least")


def spelled(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """key and word of the words whose keys are asked for, and of some others."""
    test = Bits(keys, "key").test()
    schema = pa.schema([("key", pa.int64()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for w in words_of(batches):
            some = np.flatnonzero(test(w.key))
            key, first = np.unique(w.key[some], return_index=True)
            new = ~np.isin(key, seen)
            if new.any():
                raw = w.data.tobytes()
                at = some[first[new]]
                words = [raw[a:b].decode() for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
                yield batch_of(schema, key[new].view(np.int64), words)
                seen = np.concatenate((seen if len(seen) < HELD else seen[:0], key[new]))

    return texts.mapInArrow(run, "key long, word string").groupBy("key").agg(F.min("word").alias("word"))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first top phrases."""
    spark = docs.sparkSession
    work = Scratch(spark, "collocations")
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    texts = docs.select(F.col(f"`{text_col}`").alias("text"), F.xxhash64(lang).alias("salt"))
    names = work.write(docs.select(lang.alias("lang"), F.xxhash64(lang).alias("salt")).distinct(), "languages")
    words = work.write(mined(texts, 1, None), "words")
    size = work.write(words.groupBy("salt").agg(F.sum("n").alias("n")), "size")

    def frequent(df: DataFrame, k: int) -> DataFrame:
        task = F.lit(-1).cast("long").alias("task") if k == 1 else "task"
        out = work.write(df.filter(F.col("n") >= MIN_COUNT).select("key", task), f"frequent-{k}")
        work.release()
        return out

    one = frequent(words, 1)
    two = frequent(mined(texts, 2, one), 2)
    three = frequent(mined(texts, 3, two), 3)
    candidates = work.write(one.unionByName(two).unionByName(three), "candidates")
    found, phrases = candidates.count(), two.count() + three.count()
    bits = max(0, (found // SHARD).bit_length())
    # A map task sends a shard about as many keys as it has, twice, at most.
    most = max(1, -(-2 * texts.rdd.getNumPartitions() * (found >> bits) // ASKED))
    model = work.write(functions(candidates.select("key").distinct(), bits), "functions")
    for all_send in (False, True):
        counts = work.write(added_up(sent_counts(texts, candidates, bits, all_send), model, most), "counts")
        rows = work.write(counted_rows(model, counts), "rows").filter("words > 1")
        if rows.count() >= phrases:
            break  # else the input wasn't dealt to the tasks as before, and words are missing
        work.drop("counts", "rows")
    work.drop("words", "frequent-1", "frequent-2", "frequent-3", "candidates")
    work.release()
    cuts = [("w1", 0), (F.when(F.col("words") == 2, F.col("w2")).otherwise(F.col("right")), 1), ("left", 2), ("w3", 3)]
    struct = lambda c, i: F.struct((F.col(c) if isinstance(c, str) else c).alias("key"), F.lit(i).alias("place"))
    ask = F.when(F.col("words") == 2, F.array(*[struct(c, i) for c, i in cuts[:2]])).otherwise(F.array(*[struct(c, i) for c, i in cuts]))
    asked = rows.select(F.col("key").alias("owner"), F.explode(ask).alias("x")).select("x.key", "owner", "x.place")
    found = read_by_slot(asked, model, counts, bits, work).groupBy("owner")
    found = found.agg(*[F.max(F.when(F.col("place") == i, F.col("f"))).alias(f"f{i}") for i in range(4)])
    score = lambda l, r: F.expr(  # noqa: E731, E741
        f"cast((1000000BD * (cast(a as decimal(16,0)) * cast(a as decimal(16,0)))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0))) as long)"
    )
    scored = rows.join(found.withColumnRenamed("owner", "key"), "key").withColumns({"s0": score("f0", "f1"), "s1": score("f2", "f3")})
    second = F.coalesce(F.col("s1") < F.col("s0"), F.lit(False))
    pick = lambda x, y: F.when(second, F.col(y)).otherwise(F.col(x))
    scored = scored.withColumns({"score": pick("s0", "s1"), "l": pick("f0", "f2"), "r": pick("f1", "f3")})
    longer = rows.filter("words = 3").select("a", F.explode(F.array("left", "right")).alias("key"))
    longer = longer.groupBy("key").agg(F.max("a").alias("within"))
    kept = scored.join(longer, "key", "left").filter(f"within is null or 100 * within < {HALF_PERCENT} * a")
    kept = work.write(kept.select("key", "salt", "w1", "w2", "w3", "a", "l", "r", "score"), "scored")
    few = work.write(first_rows(best_scores(kept, top, work), "salt", [F.desc("score"), F.desc("a")], top, F.rank).drop("rank"), "few")
    keys = work.write(few.select(F.explode(F.array("w1", "w2", "w3")).alias("key")).filter("key <> 0").distinct(), "word-keys")
    known = work.write(by_ids(spelled(texts, keys), keys, "key"), "spelled")
    for w in ("w1", "w2", "w3"):
        few = by_ids(few, known.select(F.col("key").alias(w), F.col("word").alias(f"{w}_text")), w, "left")
    few = few.withColumn("phrase", F.concat_ws(" ", "w1_text", "w2_text", "w3_text"))
    out = first_rows(few, "salt", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, F.row_number)
    out = by_ids(by_ids(out, names, "salt", "inner"), size, "salt", "inner")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


SQL = {
    "op13_collocations": r"""
WITH p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, w[i : i + k - 1] AS g
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 10),
u AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT u.lang, u.k, u.g, u.a, u.cut, x.f AS l, y.f AS r, (1000000 * u.a * u.a) // (x.f * y.f) AS score
  FROM u JOIN f x ON x.lang = u.lang AND x.g = u.g[1 : u.cut] JOIN f y ON y.lang = u.lang AND y.g = u.g[u.cut + 1 :]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
t AS (
  SELECT lang, g, max(a) AS within
  FROM (SELECT lang, g[1:2] AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3], a FROM c WHERE k = 3) GROUP BY ALL),
r AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, n.n, b.score
  FROM b JOIN n USING (lang) LEFT JOIN t ON t.lang = b.lang AND t.g = b.g WHERE t.within IS NULL OR 100 * t.within < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM r QUALIFY rank <= 2000
"""
}
