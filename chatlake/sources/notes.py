"""Markdown notes as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def notes(spark: SparkSession, root: str, limit_bytes: int = 1_000_000) -> DataFrame:
    """path (relative to root), revision (digest of the bytes), text, modified_at and skipped of every note.

    skipped says why a note has no text: too_large or not_utf8; else it is null.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    large = F.col("length") > limit_bytes
    place = F.regexp_replace("path", rf"^(?:\w+:/*)?/?\Q{root.split(':', 1)[-1].strip('/')}\E/", "")
    return raw.select(place.alias("path"), F.sha2("content", 256).alias("revision"), F.when(~large, text).alias("text"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_at"), F.when(large, "too_large").when(text.isNull(), "not_utf8").alias("skipped"))
