"""Tables that queries share are made once, as an import would, and read from then on."""

from __future__ import annotations

import atexit
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chatlake.operators.scratch import delete, folder

PART = 64 << 20
#: By application, source and name: what the source was like, the table made of it, and its rows.
_made: dict[tuple[str, str, str], tuple[object, DataFrame, int]] = {}


def state_of(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of each file of a table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def stored(spark: SparkSession, source: str, table: str, name: str, build: Callable[[], DataFrame], by: Sequence[str] = (), number: str | None = None) -> DataFrame:
    """The table that build() makes of a table of the source, written at its first use in this application and read after that.

    It is made again once the source's files have changed. by: columns whose order its files and rows follow, so that readers
    can skip some; there are as many files as the source has PART bytes, and at least one a core. number: a column for the
    rows' numbers, one after the other within a file.
    """
    key = (spark.sparkContext.applicationId, source, name)
    state = state_of(spark, f"{source}/{table}.parquet")
    if key not in _made or _made[key][0] != state:
        path = folder(spark)
        df = build()
        if by:
            parts = max(spark.sparkContext.defaultParallelism, sum(size for _, size, _ in state) // PART)
            df = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        df = df.withColumn(number, F.monotonically_increasing_id()) if number else df
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        atexit.register(delete, spark, path)
        _made[key] = (state, spark.read.schema(df.schema).parquet(path), seen.get["n"])
    return _made[key][1]


def rows_of(spark: SparkSession, source: str, name: str) -> int:
    """Rows of a table that stored() has made, as counted when it was written."""
    return _made[spark.sparkContext.applicationId, source, name][2]
