"""The search index on disk: for each token the sorted numbers of the messages that hold it, in blocks and segments.

Messages are numbered in the order of import; a block is BLOCK numbers in a row. A row has token, block, n and docs, the
sorted places within the block, so no row is longer than a block however common its token. Each import adds a segment;
segments of like size are merged. Within a segment rows lie in folders by the token's hash, sorted by token, so a query opens
the folders of its own tokens and skips to them by the footers' minima and maxima. Numbers are stored as differences
(DELTA_BINARY_PACKED). A query intersects the arrays of each block, rarest token first.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions.text import index_tokens
from chatlake.operators.commits import Log

BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
SCHEMA = "token string, block long, n long, docs array<int>"
#: Messages a folder of a segment, about, and the most folders.
PER_BUCKET, BUCKETS = 50_000, 256
#: Segments of like size (within this factor) that are merged, once there are so many.
MERGE = 4


def bucket_of(token: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def buckets_for(messages: int) -> int:
    return min(BUCKETS, 1 << max(0, (messages // PER_BUCKET)).bit_length())


def postings(rows: DataFrame, buckets: int) -> DataFrame:
    """The index rows of messages (doc, search_text). A group of one token and block has at most BLOCK members."""
    each = rows.filter("search_text is not null").select("doc", F.explode(index_tokens(F.col("search_text"))).alias("token"))
    place = F.col("doc").bitwiseAND(F.lit(BLOCK - 1)).cast("int")
    lists = each.groupBy("token", F.shiftright("doc", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(place)).alias("docs"))
    return _filed(lists, buckets)


def _filed(lists: DataFrame, buckets: int) -> DataFrame:
    rows = lists.select("token", "block", F.size("docs").cast("long").alias("n"), "docs", bucket_of("token", buckets).alias("bucket"))
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "token", "block")


def merged(rows: DataFrame, buckets: int) -> DataFrame:
    """Segments as one: the arrays of a token and block that several imports share become one sorted array."""
    lists = rows.groupBy("token", "block").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("docs"))
    return _filed(lists, buckets)


def stored(spark: SparkSession, rows: DataFrame, path: str, buckets: int) -> None:
    """An index by itself, outside of an archive."""
    out = postings(rows, buckets).write.partitionBy("bucket")
    out.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").parquet(path)


def bucket_numbers(spark: SparkSession, tokens: Sequence[str], sizes: Sequence[int]) -> dict[int, set[int]]:
    """Which folders hold the tokens, by the number of folders."""
    asked = spark.createDataFrame([(t,) for t in tokens], "token string")
    row = asked.agg(*[F.collect_set(bucket_of("token", b)).alias(str(b)) for b in set(sizes)]).first()
    return {b: set(row[str(b)]) for b in set(sizes)}


def lookup(spark: SparkSession, segments: Sequence[tuple[str, int, set[int]]], tokens: Sequence[str]) -> DataFrame:
    """The index rows of the tokens. segments: (path, number of folders, folders that there are)."""
    tokens = sorted(set(tokens))
    wanted = bucket_numbers(spark, tokens, [b for _, b, _ in segments]) if segments else {}
    paths = [f"{p}/bucket={k}" for p, b, there in segments for k in sorted(wanted[b] & there)]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*paths).filter(F.col("token").isin(*tokens))


def holding_all(rows: DataFrame, tokens: Sequence[str], several: bool = True) -> DataFrame:
    """doc of the messages that hold all tokens; rows are the tokens' index rows.

    Meets by block only: a block's rows are at most one array of BLOCK numbers a token. several: whether a token and block
    may have several rows, as in segments that aren't merged.
    """
    if several:
        rows = rows.groupBy("block", "token").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("docs")).alias("docs"))
    if len(set(tokens)) == 1:
        docs = rows.select("block", "docs")
    else:
        lists = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("n", "docs"))).alias("lists"))
        lists = lists.filter(F.size("lists") == len(set(tokens)))
        rarest = F.col("lists")[0]["docs"]
        both = F.aggregate(F.slice("lists", 2, len(set(tokens))), rarest, lambda acc, x: F.array_intersect(acc, x["docs"]))
        docs = lists.select("block", both.alias("docs"))
    docs = docs.select("block", F.explode("docs").alias("place"))
    return docs.select((F.shiftleft("block", BLOCK_BITS) + F.col("place")).alias("doc"))


# The index of an archive.


def segments(log: Log) -> list[tuple[str, int, set[int]]]:
    return [(f"{log.root}/{e['path']}", j["index_buckets"], set(e["buckets"])) for j, e in log.parts("postings")]


def candidates(log: Log, tokens: Sequence[str]) -> DataFrame:
    """doc of the messages that hold all the tokens."""
    own = segments(log)
    return holding_all(lookup(log.spark, own, tokens), tokens, len(own) > 1)


def merge(log: Log, now: datetime) -> dict | None:
    """Merges the segments of like size once there are MERGE of them; None where there is nothing to do."""

    def build(base: Log, job: dict) -> tuple[dict, dict[str, DataFrame]] | None:
        parts = sorted(base.parts("postings"), key=lambda x: x[1]["rows"])
        for i in range(len(parts) - MERGE + 1):
            like = [p for p in parts[i:] if p[1]["rows"] <= MERGE * max(parts[i][1]["rows"], 1)]
            if len(like) >= MERGE:
                paths = [f"{base.root}/{e['path']}/bucket={b}" for _, e in like for b in e["buckets"]]
                rows = base.spark.read.schema(SCHEMA).parquet(*paths)
                buckets = buckets_for(sum(j.get("indexed", 0) for j, _ in like))
                more = {"index_buckets": buckets, "indexed": sum(j.get("indexed", 0) for j, _ in like)}
                return more | {"drops": {"postings": [j["attempt"] for j, _ in like]}}, {"postings": merged(rows, buckets)}
        return None

    return log.change(build, "merge", now)


def rebuild(log: Log, revisions: str, now: datetime) -> dict | None:
    """The whole index anew from the messages; readers use the old one until it is there."""

    def build(base, job: dict) -> tuple[dict, dict[str, DataFrame]]:
        rows = base.table(revisions).filter("doc is not null")
        n = rows.count()
        old = [j["attempt"] for j, _ in base.parts("postings")]
        more = {"index_buckets": buckets_for(n), "indexed": n, "drops": {"postings": old}}
        return more, {"postings": postings(rows, buckets_for(n))}

    return log.change(build, "merge", now)
