"""Quality rules: divergence of a text's histograms from those of its language (operator 7).

Two histograms of each document, of character classes and of common words, are compared by Jensen-Shannon distance with
references of its language, which are the summed histograms of the documents labelled good. A language's common words are
learned too: the COMMON most frequent ones of its good documents; all others share one more bin. Each language's limits are
quantiles of the distances of its own good documents, found by counting distances in fixed bins. Texts under MIN_CHARS
or MIN_WORDS are too short to be judged by a histogram and pass; so do texts of a language without a reference.

The base rules come first: base_failed means n_words < 20, or 100 * n_repeat_words > 30 * n_words.
A null text has no words; a null language is a language of its own; repeated rows and ids count each; other columns are
ignored. One row results for each row.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from llm.common import Scratch, batch_of, by_ids, chunks, table, with_ids
from llm.wordhash import BLANK, BYTE, span_hashes, windows, word_bounds

SPAN = 8
MIN_WORDS = 50
MIN_CHARS = 200
#: Share of the good documents of a language that a limit lets pass, and what is added to it.
QUANTILE = 0.995
SLACK = 0.02
BINS = 2000
#: Character classes: lower, upper, digit, blank, sentence mark, other ASCII mark, letter beyond ASCII.
CLASSES = 7
_CLASS = np.full(256, 6, np.int64)
_CLASS[0:128] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Common words of a language.
COMMON = 100
_STRIP = ".,;:!?'\"()"


def _edges() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in _STRIP]] = True
    return out


_EDGE = _edges()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bare_words(buf: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are more than marks, and these words' hashes, without marks and with A-Z lower-cased."""
    bare = inside & ~_EDGE[buf]
    kept = np.add.reduceat(bare, starts) if len(starts) else np.zeros(0, np.int64)
    size = kept[kept > 0]
    to = np.cumsum(size)
    return kept > 0, span_hashes(BYTE[_LOWER[buf[bare]]], to - size, to)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (a hash) and n, added up inside tasks; docs: lang and text."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(every)):
                of, total = batch.column(1).filter(pa.array(every == lang)), collections.Counter()
                for _, _, buf, off in chunks(of):
                    starts, _, _, inside = word_bounds(buf, off, BLANK)
                    h, n = np.unique(bare_words(buf, starts, inside)[1], return_counts=True)
                    total.update(dict(zip(h.view(np.int64).tolist(), n.tolist(), strict=True)))
                yield batch_of(schema, [lang] * len(total), list(total), list(total.values()))

    return docs.mapInArrow(run, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame) -> dict[str, np.ndarray]:
    """The sorted hashes of each language's common words: COMMON numbers a language."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    out: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).filter(F.col("rank") <= COMMON).collect():
        out.setdefault(r["lang"], []).append(r["word"])
    return {lang: np.sort(np.array(words, np.int64).view(np.uint64)) for lang, words in out.items()}


def measure(buf: np.ndarray, off: np.ndarray, langs: list[str], known: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Base figures and histograms of each text; known: common words of the languages."""
    n = len(off) - 1
    starts, ends, words, inside = word_bounds(buf, off, BLANK)
    n_words = np.diff(words)
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[off])
    lead = (buf & 0xC0) != 0x80
    row = np.repeat(np.arange(n), np.diff(off))
    classes = np.bincount(row[lead] * CLASSES + _CLASS[buf[lead]], minlength=n * CLASSES).reshape(n, CLASSES)
    common = np.zeros((n, COMMON + 1), np.int64)
    worded, h = bare_words(buf, starts, inside)
    doc = np.repeat(np.arange(n), n_words)[worded]
    names = np.array(langs, object)
    for lang in set(langs) & known.keys():
        some = (names == lang)[doc]
        of, own = known[lang], h[some]
        at = np.minimum(np.searchsorted(of, own), len(of) - 1)
        np.add.at(common, (doc[some], np.where(of[at] == own, at, COMMON)), 1)
    every = windows(span_hashes(BYTE[buf], starts, ends), SPAN)
    repeat, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = buf.tobytes()
    for d in range(n):
        a, b = words[d], words[d + 1]
        if b - a > SPAN:
            own = every[a : b - SPAN + 1]
            _, back, count = np.unique(own, return_inverse=True, return_counts=True)
            twice = np.flatnonzero(count[back] > 1)
            if len(twice):
                cover = np.zeros(b - a + 1, np.int64)
                np.add.at(cover, twice, 1)
                np.add.at(cover, twice + SPAN, -1)
                repeat[d] = np.count_nonzero(np.cumsum(cover)[:-1])
        seen: set[bytes] = set()
        for line in raw[off[d] : off[d + 1]].split(b"\n"):
            if line in seen:
                lines[d] += 1
            elif line.split():
                seen.add(line)
    return {"n_words": n_words, "word_chars": total(inside & lead), "n_symbols": total(_SYMBOL[buf]), "n_dup_lines": lines, "n_repeat_words": repeat, "classes": classes, "common": common}


_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(own: DataFrame, known: dict[str, np.ndarray]) -> DataFrame:
    """own: id, lang and text."""
    shared = own.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), *[(c, pa.int64()) for c in _NUMBERS], ("classes", pa.list_(pa.int64())), ("common", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in chunks(batch.column(2)):
                m = measure(buf, off, batch.column(1).slice(a, b - a).to_pylist(), shared.value)
                yield batch_of(schema, batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[m[c] for c in _NUMBERS], m["classes"].tolist(), m["common"].tolist())

    return own.mapInArrow(run, f"id long, lang string, {', '.join(c + ' long' for c in _NUMBERS)}, classes array<long>, common array<long>")


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (roots of the divergences in bits, 0 to 1) of rows of histograms; 0 if either is empty."""
    sums = p.sum(1) * q.sum(1)
    p, q = (x / np.maximum(x.sum(1, keepdims=True), 1) for x in (p, q))
    m = np.maximum((p + q) / 2, 1e-300)
    part = lambda x: np.where(x > 0, x * np.log2(np.maximum(x, 1e-300) / m), 0).sum(1)
    return np.where(sums > 0, np.sqrt(np.maximum((part(p) + part(q)) / 2, 0)), 0)


@F.pandas_udf(DoubleType())
def jensen_shannon(p: pd.Series, q: pd.Series) -> pd.Series:
    """Null where a histogram is null."""
    both = (p.notna() & q.notna()).to_numpy()
    out = np.full(len(p), np.nan)
    if both.any():
        out[both] = distances(np.stack(p[both].to_numpy()).astype(float), np.stack(q[both].to_numpy()).astype(float))
    return pd.Series(out).where(both, None)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """id_col, n_words, the base figures, base_failed, kept, and both distances, for every row of docs.

    labels has id_col and quality; documents with quality 1 are good. References and limits are one small row a language,
    gathered over all good documents.
    """
    work = Scratch(docs.sparkSession, "quality-rules")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    good = work.write(with_ids(labels, id_col, "quality").filter("quality = 1").select(F.col(id_col).cast("long").alias("id")).distinct(), "good")
    known = common_words(work.write(word_counts(by_ids(own, good, "id").select("lang", "text")), "words"))
    rows = work.write(measured(own, known), "measured")
    good = by_ids(rows, good, "id")
    sums = [F.sum(F.col("classes")[i]).alias(f"x{i}") for i in range(CLASSES)] + [F.sum(F.col("common")[i]).alias(f"y{i}") for i in range(COMMON + 1)]
    ref = work.write(good.groupBy("lang").agg(*sums).select("lang", F.array(*[f"x{i}" for i in range(CLASSES)]).alias("ref_classes"), F.array(*[f"y{i}" for i in range(COMMON + 1)]).alias("ref_common")), "reference")
    far = lambda df: df.join(ref, "lang", "left").withColumns({
        "class_distance": F.when(F.col("word_chars") >= MIN_CHARS, jensen_shannon("classes", "ref_classes")),
        "word_distance": F.when(F.col("n_words") >= MIN_WORDS, jensen_shannon("common", "ref_common")),
    })
    limits = far(good).select("lang", F.explode(F.array(F.struct(F.lit("c").alias("what"), F.col("class_distance").alias("v")), F.struct(F.lit("w").alias("what"), F.col("word_distance").alias("v")))).alias("x")).select("lang", "x.*").filter("v is not null")
    limits = limits.groupBy("lang", "what", F.floor(F.col("v") * BINS).alias("bin")).count()
    limits = limits.groupBy("lang", "what").agg(F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("h"), F.sum("count").alias("n"))
    upto = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin")), lambda acc, x: F.struct((acc["seen"] + x["count"]).alias("seen"), F.coalesce(acc["bin"], F.when(acc["seen"] + x["count"] >= F.ceil(F.lit(quantile) * F.col("n")), x["bin"])).alias("bin")), lambda acc: (acc["bin"] + 1) / BINS)
    limits = limits.select("lang", "what", (upto + slack).alias("limit"))
    limits = work.write(limits.groupBy("lang").agg(F.max(F.when(F.col("what") == "c", F.col("limit"))).alias("class_limit"), F.max(F.when(F.col("what") == "w", F.col("limit"))).alias("word_limit")), "limits")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = far(rows).join(limits, "lang", "left")
    strange = F.coalesce(F.col("class_distance") > F.col("class_limit"), F.lit(False)) | F.coalesce(F.col("word_distance") > F.col("word_limit"), F.lit(False))
    return out.select(F.col("id").alias(id_col), *_NUMBERS, failed.alias("base_failed"), (~failed & ~strange).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
