"""WARC fixity audit with Merkle trees over offset ranges (operator 1).

A record's leaf is its digest. A node of the lowest level covers the records that start in one range of LEAF bytes of a
file, in order of offset; each higher level covers FAN neighbouring ranges, up to the root of the file. Two replicas are
compared root by root, and only below mismatching nodes do their children meet, down to the records. Ranges bound each
group by the bytes it covers, however many records a file has, so no file is gathered in one task.

Defined results: null payload fields count as empty; records of equal file and offset with equal content count once; a
record that only one replica has is missing or extra; equal replicas and empty tables give no rows; repeated pages are
records of their own, one behind the other; pages without an id are spread over SPREAD files by their digests. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import Scratch, table, with_ids

LEAF_BITS, FAN_BITS, TOP_BITS = 16, 4, 40
RECORDS_PER_FILE, SPREAD = 1000, 4096


def levels() -> list[int]:
    """Bits of offset that a node of each level covers, lowest first."""
    return list(range(LEAF_BITS, TOP_BITS + 1, FAN_BITS))


def tree(records: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Node tables (file, range, digest) of each level, lowest first, then a last one of roots; records: file, offset, length, digest."""
    entry = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), F.col("length").cast("string"), "digest")
    made = []
    below = records.select("file", F.shiftright("offset", LEAF_BITS).alias("range"), entry.alias("entry"))
    for level in [*levels(), None]:
        nodes = below.groupBy("file", "range").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), "\n"), 256).alias("digest"))
        made.append(nodes := scratch.write(nodes, f"{name}-{level or 'root'}"))
        up = F.shiftright("range", FAN_BITS) if level is not None and level < TOP_BITS else F.lit(0).cast("long")
        below = nodes.select("file", up.alias("range"), F.concat_ws(":", F.lpad(F.col("range").cast("string"), 20, "0"), "digest").alias("entry"))
    return made


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Damaged records: file, offset, length, status (corrupt, missing or extra in the replica) and both digests.

    Both inputs have file, offset, length and digest; offsets must be below 2 ** TOP_BITS times the fan-out.
    """
    scratch = Scratch(primary.sparkSession, "warc-audit")
    left, right = (scratch.write(with_ids(df, "file", "offset", "length", "digest").distinct(), n) for df, n in ((primary, "primary"), (replica, "replica")))
    differ = None
    trees = [*zip(tree(left, scratch, "p"), tree(right, scratch, "r"), strict=True)]
    for depth, (a, b) in enumerate(reversed(trees)):
        if differ is not None:  # only the children of nodes that differ
            shift = FAN_BITS if depth > 1 else 63
            a, b = (x.join(differ, (x["file"] == differ["up_file"]) & (F.shiftright(x["range"], shift) == differ["up_range"]), "left_semi") for x in (a, b))
        found = a.alias("a").join(b.alias("b"), ["file", "range"], "full_outer").filter(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
        differ = scratch.write(found.select(F.col("file").alias("up_file"), F.col("range").alias("up_range")), f"differ-{depth}")
    a, b = (x.join(differ, (x["file"] == differ["up_file"]) & (F.shiftright(x["offset"], LEAF_BITS) == differ["up_range"]), "left_semi") for x in (left, right))
    both = a.alias("a").join(b.alias("b"), ["file", "offset"], "full_outer").filter(~F.struct("a.length", "a.digest").eqNullSafe(F.struct("b.length", "b.digest")))
    status = F.when(F.col("b.digest").isNull(), "missing").when(F.col("a.digest").isNull(), "extra").otherwise("corrupt")
    return both.select("file", "offset", F.coalesce("a.length", "b.length").alias("length"), status.alias("status"), F.col("a.digest").alias("expected"), F.col("b.digest").alias("found"))


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The WARC response record of a page."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    end = F.lit("\r\n")
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), text(page_id), F.lit(">\r\nWARC-Target-URI: "), text(url), F.lit("\r\nContent-Length: "), F.octet_length(text(html)).cast("string"), end, end, text(html), end, end)


def located(pages: DataFrame, payload: Column, stored: Column | None = None) -> DataFrame:
    """file, offset, length, digest and found of each page's record, in files of RECORDS_PER_FILE consecutive ids.

    digest is that of the payload, found that of the bytes stored in a replica (null: it has lost the record). Both are
    hashed where the page is read; only digests and lengths are shuffled, and a window holds the records of one file.
    """
    digest = F.sha2(payload, 256)
    own = F.coalesce(F.floor(F.col("page_id") / RECORDS_PER_FILE).cast("long"), -1 - F.pmod(F.xxhash64(digest), F.lit(SPREAD)))
    rows = pages.select("page_id", own.alias("file"), F.octet_length(payload).cast("long").alias("length"), digest.alias("digest"), (digest if stored is None else F.sha2(stored, 256)).alias("found"))
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).select("file", "offset", "length", "digest", "found")


def drill(pages: DataFrame) -> DataFrame:
    """Audits the records of all pages against a replica with damage of a known kind.

    In the replica the last byte is another in the records with page_id % 97 = 13, and those with page_id % 211 = 7 are lost.
    """
    pages = with_ids(pages, "page_id", "url", "html")
    payload, page = record(F.col("page_id"), F.col("url"), F.col("html")), F.col("page_id")
    hurt = F.when(page % 97 == 13, F.concat(payload.substr(F.lit(1), F.length(payload) - 1), F.lit("!"))).otherwise(payload)
    stored = F.when(F.coalesce(page % 211 != 7, F.lit(True)), hurt)
    both = Scratch(pages.sparkSession, "warc-records").write(located(pages, payload, stored), "records")
    return audit(both.drop("found"), both.filter("found is not null").drop("digest").withColumnRenamed("found", "digest"))


def op1_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drill(table(spark, sf_dir, "pages"))


SQL = {
    "op1_warc_fixity_audit": r"""
WITH r AS (
  SELECT page_id, page_id // 1000 AS file, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS p FROM pages),
o AS (SELECT *, strlen(p) AS length, sum(strlen(p)) OVER (PARTITION BY file ORDER BY page_id) - strlen(p) AS "offset" FROM r)
SELECT CAST(file AS BIGINT) AS file, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, CASE WHEN page_id % 211 = 7 THEN 'missing' ELSE 'corrupt' END AS status,
  sha256(p) AS expected, CASE WHEN page_id % 211 <> 7 THEN sha256(left(p, len(p) - 1) || '!') END AS found
FROM o WHERE page_id % 97 = 13 OR page_id % 211 = 7
"""
}
