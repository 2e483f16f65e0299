"""Records of installed extensions: manifests found below folders, their status, and search over them.

Manifests are small files; they are found and read by Spark's file source, one row each.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

VENDOR = r"/(node_modules|\.git|vendor|__pycache__|dist|build)/"
MAX_BYTES, MOST = 256 << 10, 500
FIELDS = ("kind", "name", "version", "description", "status", "path")


@F.pandas_udf(MapType(StringType(), StringType()))
def manifest_fields(text: pd.Series, name: pd.Series) -> pd.Series:
    """Plain values of a JSON or TOML manifest, or of the front matter of Markdown; empty where it can't be read."""

    def read(t: str, n: str) -> dict[str, str]:
        try:
            if n.endswith(".json"):
                found = json.loads(t)
            elif n.endswith(".toml"):
                found = tomllib.loads(t)
            else:
                head = t.split("---", 2)[1] if t.startswith("---") and t.count("---") > 1 else ""
                found = dict(line.split(":", 1) for line in head.splitlines() if ":" in line and line[:1].strip())
        except (ValueError, IndexError):
            return {}
        return {str(k).strip(): str(v).strip().strip("\"'") for k, v in found.items() if isinstance(v, (str, int, float, bool))} if isinstance(found, dict) else {}

    return pd.Series([read(t or "", n or "") for t, n in zip(text, name, strict=True)])


def manifests(spark: SparkSession, root: str, names: Sequence[str], kind: str) -> DataFrame:
    """kind, name, version, description and path of the manifests below a folder, but those in vendors' folders and too large ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    own = F.element_at(F.split("path", "/"), -1)
    files = files.filter(own.isin(*names) & ~F.col("path").rlike(VENDOR) & (F.col("length") <= MAX_BYTES))
    rows = files.select("path", manifest_fields(F.try_validate_utf8(F.col("content").cast("string")), own).alias("f"))
    folder = F.element_at(F.split("path", "/"), -2)
    return rows.select(F.lit(kind).alias("kind"), F.coalesce(F.col("f")["name"], folder).alias("name"), F.col("f")["version"].alias("version"), F.coalesce(F.col("f")["description"], F.lit("")).alias("description"), "path")


def with_status(found: DataFrame, configured: DataFrame) -> DataFrame:
    """status: active if a configuration (name, enabled) turns it on, disabled if off, else cached."""
    on = configured.groupBy("name").agg(F.max("enabled").alias("enabled"))
    return found.join(on, "name", "left").withColumn("status", F.when(F.col("enabled"), "active").when(~F.col("enabled"), "disabled").otherwise("cached")).drop("enabled")


def of_profiles(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """What profiles bundle (profile, name, version), with whether it is installed, in another version, or missing."""
    have = installed.groupBy("name").agg(F.collect_set("version").alias("versions"), F.min("path").alias("path"))
    status = F.when(F.col("versions").isNull(), "missing").when(F.col("version").isNull() | F.array_contains("versions", F.col("version")), "installed").otherwise("other_version")
    return wanted.join(have, "name", "left").withColumn("status", status).drop("versions")


def unlisted(installed: DataFrame, wanted: DataFrame) -> DataFrame:
    return installed.join(wanted.select("name").distinct(), "name", "left_anti").withColumn("status", F.lit("runtime"))


def union(sources: Sequence[DataFrame], most: int = MOST) -> DataFrame:
    """Records of all sources, each key (kind, name, path) once, the last source's; by kind, name and path, and no more than most."""
    every = None
    for i, df in enumerate(sources):
        one = df.select(*[F.col(c).cast("string").alias(c) for c in FIELDS], F.lit(i).alias("_source"))
        every = one if every is None else every.unionByName(one)
    w = Window.partitionBy("kind", "name", "path").orderBy(F.col("_source").desc())
    return every.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth", "_source").orderBy("kind", F.lower("name"), "path").limit(most)


def counts(records: DataFrame) -> DataFrame:
    return records.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


def matching(records: DataFrame, query: str = "", kind: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """Records that hold all words of a query in any of their fields, whatever their case."""
    text: Column = F.lower(F.concat_ws("\n", *FIELDS))
    for word in query.lower().split():
        records = records.filter(text.contains(word))
    if kind is not None:
        records = records.filter(F.col("kind") == kind)
    if status is not None:
        records = records.filter(F.col("status") == status)
    return records.orderBy("kind", F.lower("name"), "path").limit(limit)
