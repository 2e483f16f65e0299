"""Filter interaction audit: what five filters remove in each of their 120 orders (operator 11).

A row's failures are a mask of five bits. Per part and label the rows' masks are aggregated into 32 signed parity sums
S[w] = sum of (-1) ** |w & mask| (a Walsh-Hadamard transform of the histogram of masks, added up where the rows are), and
inverted exactly: cell[m] = sum of S[w] * (-1) ** |w & m| over w, divided by 32. From a part's 32 cells every figure of every
order follows without another look at the documents, and the sum of a filter's removals over all orders in closed form: a
row that fails k filters is removed first by each of them in 120 / k orders.

A fails under MIN_WORDS words, B with few distinct words, C with many capitals, D with a symbol, E for a text identical to
one with a smaller id anywhere in the table. Whether E fails is asked row by row: the least id of each text (told apart by
SHA-256) is looked up by text and id together, so the copies of one text don't meet in a task.

Defined results: a null text is the empty text; a null part is the empty string; a row without an id is never a copy and
never the one that is copied, and has no labels; rows equal in id and text are both kept by E; a document is good (toxic) if
any of its labels says so. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Scratch, by_ids, table, with_ids

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
_BLANKS, _SYMBOLS, _CAPITALS = r"[\x20\x09-\x0D]+", r"[#$%&*|]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column, words: Column) -> Column:
    """The bits of A to D that a text of these words fails."""
    n, length = F.size(words), F.length(text)
    capitals = length - F.length(F.translate(text, _CAPITALS, ""))
    fails = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        100 * capitals > CAPITAL_PERCENT * length,
        text.rlike(_SYMBOLS),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, work: Scratch) -> DataFrame:
    """part, good, toxic and mask (all five bits) of every row of docs."""
    rows = docs.select(
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", F.array_remove(F.split("text", _BLANKS), ""))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    rows = work.write(rows.select("part", "id", digest, failures(F.col("text"), F.col("words")).alias("mask")), "rows")
    marks = with_ids(labels, id_col, "quality", "toxic").filter("quality = 1 or toxic = 1")
    marks = marks.groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    known = rows.filter("id is not null")
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = known.join(first, ["digest", "id"], "left")
    known = by_ids(known, work.write(marks, "labels"), "id", "left")
    fails_e = F.when(F.col("first").isNull(), CELLS >> 1).otherwise(0)
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    known = known.select("part", flag("good"), flag("toxic"), (F.col("mask") + fails_e).alias("mask"))
    none = F.lit(False)
    return known.unionByName(rows.filter("id is null").select("part", none.alias("good"), none.alias("toxic"), "mask"))


def parity(bits: Column) -> Column:
    """1 for an even number of set bits, -1 for an odd one."""
    return 1 - 2 * (F.bit_count(bits) % 2)


def parity_sums(rows: DataFrame) -> DataFrame:
    """part, and the arrays of 32 sums of all rows, of the good and of the toxic ones."""
    sums = rows.groupBy("part", "good", "toxic").agg(
        F.array(*[F.sum(parity(F.col("mask").bitwiseAND(F.lit(w)))) for w in range(CELLS)]).alias("s")
    )
    of = lambda flag, w: F.sum(F.when(flag, F.col("s")[w]).otherwise(0))
    kinds = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    return sums.groupBy("part").agg(*[F.array(*[of(f, w) for w in range(CELLS)]).alias(k) for k, f in kinds.items()])


def inverted(sums: Column) -> Column:
    """The exact counts of the 32 masks whose parity sums these are."""
    w = F.sequence(F.lit(0), F.lit(CELLS - 1))

    def cell(m: Column) -> Column:
        terms = F.zip_with(sums, w, lambda s, v: s * parity(v.bitwiseAND(m)))
        return F.shiftright(F.aggregate(terms, F.lit(0).cast("long"), lambda x, y: x + y), len(FILTERS))

    return F.transform(w, cell)


def total(cells: Column, weight) -> Column:
    """The sum over the masks m of cells[m] * weight(m)."""
    terms = F.transform(cells, lambda n, m: n * weight(m))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda x, y: x + y.cast("long"))


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Part (string), filter_order, step and the figures of that step: one row for each part, order and step.

    labels has id_col, quality and toxic. Orders are the 600 (order, step) pairs of the five filters, whatever the documents.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "filter-audit")
    kinds = ["every", "good", "toxic"]
    cells = parity_sums(masks(docs, labels, id_col, text_col, part_col, work))
    cells = work.write(cells.select("part", *[inverted(F.col(k)).alias(k) for k in kinds]), "cells")
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [
        (5 * k + i, order, i + 1, sum(bit[f] for f in order[:i]), bit[order[i]])
        for k, order in enumerate(ORDERS) for i in range(len(FILTERS))
    ]
    steps = spark.createDataFrame(steps, "k int, filter_order string, step int, before int, own int")
    rows = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) * len(FILTERS) - 1))))
    rows = rows.join(F.broadcast(steps), "k")
    before, own = F.col("before"), F.col("own")
    fails = lambda m, mask: m.bitwiseAND(mask) != 0
    yes = lambda c: F.when(c, 1).otherwise(0)
    here = lambda m: yes(fails(m, own) & ~fails(m, before))
    orders = lambda m: F.when(fails(m, own), F.expr(f"{len(ORDERS)}") / F.bit_count(m)).otherwise(0).cast("long")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(F.col("every"), lambda m: yes(~fails(m, before.bitwiseOR(own)))).alias("kept"),
        total(F.col("every"), here).alias("removed"),
        total(F.col("every"), lambda m: yes(fails(m, own) & fails(m, before))).alias("redundant"),
        total(F.col("every"), lambda m: yes(m == own)).alias("unique_fails"),
        total(F.col("good"), here).alias("good_lost"),
        total(F.col("toxic"), here).alias("toxic_lost"),
        total(F.col("every"), orders).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = {
    "op11_filter_audit": r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT t.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN l USING (doc_id)),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (
  SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (translate(fails, before || own, '') = fails), 0) AS kept,
    coalesce(sum(n) FILTER (contains(fails, own) AND translate(fails, before, '') = fails), 0) AS removed,
    coalesce(sum(n) FILTER (contains(fails, own) AND translate(fails, before, '') <> fails), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (contains(fails, own) AND translate(fails, before, '') = fails), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (contains(fails, own) AND translate(fails, before, '') = fails), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
}
