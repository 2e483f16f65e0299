"""Fuzzy line dedup by MinHash (operator 9).

A line's normal form has A-Z lower-cased, each run of blanks as one space and none at its ends. Lines with equal normal
forms are one id. Each id's set of K-character shingles gets a signature of BANDS * ROWS_A_BAND minima by one permutation
(empty bins are filled from others by a fixed hash), whose bands are the tokens that similar lines share: at the limit of
0.8 two lines share a band with a chance of about 0.995. Sizes and parities of their shingles rule out most pairs inside the
joins; candidates left are verified by their exact Jaccard similarity, and one line of each component is kept, the first
by document id, then the row's key, then line number.

Lines of fewer than K characters are one shingle, so they are similar to their exact repeats only, which share their id
already: they get no signature.

Defined results: lines with fewer than min_chars characters in normal form are never dropped (1: blank lines only); a null
or empty text has one empty line; lines repeated inside a document are dropped like others; rows equal in id and text are
the same lines, and keep or lose them together; rows with one id and other texts are told apart. Documents whose every line
with a word is dropped have nothing of their own left. Rows without an id come behind all others. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import BROADCAST_BYTES, Bits, Scratch, batch_of, by_ids, chunks, row_key, table, without_keys
from llm.linking import PACKED_DDL, SHARED, Combiner, Linking, bucket_count, changes, combined, packed, rows, unpacked
from llm.wordhash import _ORDER, mix, parities, sets_of_spans, span_hashes

K = 8
NUM, DEN = 80, 100
BANDS, ROWS_A_BAND = 10, 4
BINS = BANDS * ROWS_A_BAND
#: Kinds of rows beside those of linking. LINE, FIRST and DROP: a line's hash, document id, key and number; BASE: lines, id, key, lines with words.
LINE, FIRST, DROP, BASE = 3, 4, 5, 6
#: Lines that a map task holds before it drops those that repeat an earlier one.
HELD = 200_000
LAST = 2**63 - 1
#: Columns of 64 parities each that joined postings carry.
PARITY = [f"h{i}" for i in range(16)]
_U = np.uint64
_EMPTY = np.uint32(0xFFFFFFFF)
_CHAR = mix(np.arange(1 << 16, dtype=np.uint64) + _U(11))
_HIGH = _U(0xD6E8FEB86659FD93)


class Lines:
    """The lines of some texts: text (spaced words of all lines), begin and end in it of each normal form, doc and number."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        chars = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
        if len(chars) != len(buf):
            off = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[off]
        docs = len(off) - 1
        blank = (chars == 32) | (chars - np.uint32(9) <= 4)
        inside = ~blank
        first, last, kept = inside.copy(), inside.copy(), inside.copy()
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(chars))]
        first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
        kept[1:] |= inside[:-1]  # each word and a blank behind it
        low = chars | ((chars - np.uint32(65) < 26).astype(np.uint32) << np.uint32(5))
        low[blank] = 32
        self.text = low[kept]
        place = np.cumsum(kept)
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        begin, end = place[starts] - 1, place[ends]
        breaks = np.flatnonzero(chars == 10)
        where = np.concatenate((off[:-1], breaks + 1))
        doc = np.concatenate((np.arange(docs), np.searchsorted(off, breaks, side="right") - 1))
        order = np.lexsort((where, doc))
        self.start, self.doc = where[order], doc[order]
        self.number = np.arange(len(order)) - np.searchsorted(self.doc, self.doc)
        word = np.concatenate((np.searchsorted(starts, self.start), [len(starts)]))
        self.has_words = word[1:] > word[:-1]
        none = np.zeros(1, np.int64)
        self.begin = np.where(self.has_words, np.concatenate((begin, none))[word[:-1]], 0)
        self.end = np.where(self.has_words, np.concatenate((none, end))[word[1:]], 0)
        self.size = self.end - self.begin
        self.n_lines = np.bincount(self.doc, minlength=docs)
        self.n_worded = np.bincount(self.doc[self.has_words], minlength=docs)
        self.code = _CHAR[self.text & 0xFFFF]
        if len(self.text) and self.text.max() > 0xFFFF:
            self.code = self.code + (self.text >> 16).astype(np.uint64) * _HIGH

    def hashes(self, which: np.ndarray) -> np.ndarray:
        return span_hashes(self.code, self.begin[which], self.end[which])

    def shingles(self) -> np.ndarray:
        """Hash of the K characters from each position of text on."""
        if len(self.code) < K:
            return np.zeros(0, np.uint64)
        two = self.code[:-1] * _ORDER[0] + self.code[1:]
        four = two[:-2] * _ORDER[1] + two[2:]
        return mix(four[:-4] * _ORDER[2] + four[4:])

    def sets(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lines' shingle sets, one behind the other, and their sizes; none of lines under K characters."""
        return sets_of_spans(self.shingles(), self.begin[which], np.maximum(self.end[which] - K + 1, self.begin[which]))

    def form(self, i: int) -> bytes:
        """A line's normal form in UTF-8."""
        return self.text[self.begin[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le").encode()


def signatures(lines: Lines, which: np.ndarray) -> np.ndarray:
    """One row of BINS minima for each of the lines."""
    begin, many = lines.begin[which], lines.size[which] - K + 1
    at = np.cumsum(many) - many
    h = lines.shingles()[np.arange(int(many.sum())) + np.repeat(begin - at, many)]
    bin_ = ((h >> _U(32)) * _U(BINS) >> _U(32)).view(np.int64)
    bin_ += np.repeat(np.arange(len(which)) * BINS, many)
    out = np.full(len(which) * BINS, _EMPTY, np.uint32)
    np.minimum.at(out, bin_, h.astype(np.uint32) & np.uint32(0xFFFFFFFE))
    raw = out.reshape(-1, BINS)
    filled, tries = raw.copy(), 0
    row, hole = np.nonzero(raw == _EMPTY)
    while len(row):
        source = (mix(np.arange(BINS, dtype=np.uint64) * _U(1 << 20) + _U(tries)) % _U(BINS)).astype(np.int64)
        found = raw[row, source[hole]]
        filled[row, hole] = found
        row, hole = row[found == _EMPTY], hole[found == _EMPTY]
        tries += 1
    return filled


def band_tokens(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS_A_BAND).astype(np.uint64)
    total = (parts * _ORDER[:ROWS_A_BAND]).sum(2, dtype=np.uint64)
    return mix(total + np.arange(BANDS, dtype=np.uint64) * _ORDER[9])


def parted(h: np.ndarray, ids: np.ndarray, key: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each hash's first place by (id, key, number), and of all other places that hold it."""
    order = np.argsort(h)
    s = h[order]
    again = np.zeros(len(s), bool)
    again[1:] = s[1:] == s[:-1]
    several = again.copy()
    several[:-1] |= again[1:]
    one, more = order[~several], order[several]
    more = more[np.lexsort((number[more], key[more], ids[more], h[more]))]
    new = changes(h[more], h[more])
    first = more[np.maximum.accumulate(np.where(new, np.arange(len(more)), 0))] if len(more) else more
    same = (key[more] == key[first]) & (number[more] == number[first]) & (ids[more] == ids[first])
    return np.concatenate((one, more[new])), more[~same]


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """Postings of the bands, and LINE, DROP and BASE rows, packed. docs: id (LAST for null), key, text."""
    buckets = bucket_count(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner, held, size = Combiner(0, 1, buckets), [], 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            h, ids, key, number = (np.concatenate(x) for x in zip(*held, strict=True))
            first, other = parted(h, ids, key, number)
            yield packed(LINE, buckets, h[first], h[first], ids[first], key[first], number[first])
            yield packed(DROP, buckets, mix(key[other].view(_U)), h[other], ids[other], key[other], number[other])

        for batch in batches:
            every, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, buf, off in chunks(batch.column(2)):
                lines = Lines(buf, off)
                which = np.flatnonzero(lines.size >= min_chars)
                h, own, key = lines.hashes(which), every[a:b], keys[a:b]
                yield packed(BASE, buckets, mix(key.view(_U)), lines.n_lines, own, key, lines.n_worded)
                held.append((h, own[lines.doc[which]], key[lines.doc[which]], lines.number[which]))
                size += len(h)
                if size >= HELD:
                    yield from handed_on()
                    held, size = [], 0
                _, one = np.unique(h, return_index=True)
                one = one[lines.size[which[one]] >= K]
                if len(one):
                    tokens = band_tokens(signatures(lines, which[one])).ravel()
                    none = np.zeros(len(tokens), np.int64)
                    yield from combiner.add(tokens.view(np.int64), np.repeat(h[one], BANDS).view(np.int64), none, none)
        if size:
            yield from handed_on()
        yield from combiner.flush()

    return docs.mapInArrow(run, PACKED_DDL)


def placed(packs: pa.Table) -> list[pa.RecordBatch]:
    """FIRST rows of a bucket's lines, DROP rows of all their other places, and what else comes through."""
    line = unpacked(packs, LINE)
    first, other = parted(*line)
    return [*(rows(kind, *[x[at] for x in line]) for kind, at in ((FIRST, first), (DROP, other))), rows(DROP, *unpacked(packs, DROP)), rows(BASE, *unpacked(packs, BASE))]


def line_sets(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Shingle sets of texts that are single lines."""
    lines = Lines(buf, off)
    value, size = lines.sets(np.arange(len(lines.size)))
    return np.split(value, np.cumsum(size)[:-1])


def traits_of(docs: DataFrame, ids: DataFrame, keys: DataFrame) -> DataFrame:
    """For ids of lines: id, many (distinct shingles), PARITY, wide, and blob, their normal form.

    keys are those of the rows that hold the lines' first places; only these rows of docs (key, text) are taken apart. An id
    has a row or several equal ones, and the bits let a few other lines through.
    """
    passes, holds = Bits(ids, "id").test(), Bits(keys, "key").test()
    schema = pa.schema([("id", pa.int64()), ("many", pa.int64()), *[(c, pa.int64()) for c in PARITY], ("wide", pa.binary()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            some = batch.filter(pa.array(holds(batch.column(0).to_numpy())))
            for _, _, buf, off in chunks(some.column(1)):
                lines = Lines(buf, off)
                which = np.flatnonzero(lines.size >= K)
                h = lines.hashes(which).view(np.int64)
                wanted = np.flatnonzero(passes(h))
                new = {g: i for g, i in zip(h[wanted].tolist(), which[wanted].tolist(), strict=True) if g not in done}
                done |= new.keys()
                at = np.array(list(new.values()), np.int64)
                if len(at):
                    value, many = lines.sets(at)
                    bits, wide = parities(np.repeat(np.arange(len(at)), many), value, many, len(PARITY))
                    yield batch_of(schema, list(new), many, *bits, wide, [lines.form(i) for i in at.tolist()])

    return docs.mapInArrow(run, "id long, many long, " + ", ".join(f"{c} long" for c in PARITY) + ", wide binary, blob binary")


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, work: Scratch, held: int | None = None) -> tuple[DataFrame, DataFrame]:
    """base: id, key, n_lines and n_worded of every row; and gone: key and dropped, sorted numbers of lines, where there are any."""
    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("id"), row_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
    found = combined(line_rows(own, max(1, min_chars)), work, 0, 1, placed)
    ids = work.write(found.filter(F.col("kind") == SHARED).select("id").distinct(), "ids")
    keys = by_ids(found.filter(F.col("kind") == FIRST).select(F.col("token").alias("id"), F.col("n").alias("key")), ids, "id").select("key").distinct()
    traits = work.write(traits_of(own.select("key", "text"), ids, work.write(keys, "keys")), "traits")
    once = work.write(traits.groupBy("id").agg(F.min("many").alias("many"), *[F.min(c).alias(c) for c in PARITY], F.min("wide").alias("wide")), "once")
    blobs_of = lambda some: by_ids(traits.select("id", "blob"), some, "id").dropDuplicates(["id"])
    linked = Linking(found, once, blobs_of, line_sets, work, NUM, DEN, held=held).join_all()
    members = linked.select(F.col("node").alias("token"), "component").union(linked.select("component", "component").distinct())
    at = F.struct("id", F.col("n").alias("key"), F.col("pos").alias("number"))
    lines = by_ids(found.filter(F.col("kind") == FIRST), work.write(members, "members"), "token", "inner")
    lines = work.write(lines.select("component", at.alias("at")), "lines")
    first = work.write(lines.groupBy("component").agg(F.min("at").alias("first")).select("component", F.col("first.key").alias("k"), F.col("first.number").alias("l")), "first")
    fuzzy = by_ids(lines, first, "component", "inner").filter("at.key <> k or at.number <> l").select("at.key", "at.number")
    exact = found.filter(F.col("kind") == DROP).select(F.col("n").alias("key"), F.col("pos").alias("number"))
    gone = work.write(exact.union(fuzzy).groupBy("key").agg(F.array_sort(F.collect_set(F.col("number").cast("int"))).alias("dropped")), "gone")
    base = found.filter(F.col("kind") == BASE).select(F.when(F.col("id") != LAST, F.col("id")).alias("id"), F.col("n").alias("key"), F.col("token").alias("n_lines"), F.col("pos").alias("n_worded"))
    work.drop("ids", "keys", "traits", "once", "members", "lines", "first", "third-joined")
    return base, gone


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, held: int | None = None) -> DataFrame:
    """For every row: id_col, n_lines, n_worded (lines with words), dropped (sorted numbers of lines to drop, from 0).

    Lines of fewer than min_chars (at least 1) are left out of it. held: edges that one task may join up.
    """
    base, gone = dropped_lines(docs, id_col, text_col, min_chars, Scratch(docs.sparkSession, "line-dedup"), held)
    return base.join(gone, "key", "left").select(F.col("id").alias(id_col), "n_lines", "n_worded", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents less their duplicate lines, with all their columns; those with nothing of their own left go.

    Of rows equal in id and text one stays.
    """
    work = Scratch(docs.sparkSession, "line-dedup-texts")
    base, gone = dropped_lines(docs, id_col, text_col, 1, work)
    once = work.write(base.groupBy("key").count().filter("count > 1").select("key"), "once")
    work.drop("combined")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no name of the caller's meets one of ours
    rows_ = without_keys(docs, once.limit(0), id_col, text_col, once).select(own, row_key(id_col, text_col).alias("key"))
    size = gone.agg(F.sum(4 * F.size("dropped") + 64)).first()[0] or 0
    out = rows_.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, "key", "left")
    text = F.col("row")[text_col]
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    new = F.when(F.col("dropped").isNull(), text).otherwise(kept)
    out = out.withColumn("new", new).filter(F.col("dropped").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    cells = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("new")}
    if length_col in docs.columns:
        cells[length_col] = F.when(F.col("dropped").isNull(), cells[length_col]).otherwise(F.length("new").cast(docs.schema[length_col].dataType))
    return out.select(*[cell.alias(c) for c, cell in cells.items()])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = duplicate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))
