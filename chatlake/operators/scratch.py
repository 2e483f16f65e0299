"""Folders for tables that cut lineage: shared by all executors, gone when the driver ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """A folder all executors share: below spark.checkpoint.dir, or a temporary one where Spark runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not path and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(path or f'file://{tempfile.gettempdir()}/archive').rstrip('/')}/archive-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table as written: read from files, whatever it was made of."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, schema: str, rows: Sequence[Sequence] = ()) -> DataFrame:
    """A short list of the driver's as a table; without times. It goes as Arrow: of plain rows, each executor would start Python."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.types)], schema=kinds), schema)


def delete(spark: SparkSession, path: str) -> None:
    jvm, context = spark._jvm, spark.sparkContext._jsc
    if jvm is not None and context is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context.hadoopConfiguration()).delete(where, True)
