"""What the operators of this package share: scratch tables, size-checked joins and access to Arrow text."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a join may broadcast, by the counted rows and CELL bytes for each of their columns.
BROADCAST_BYTES, CELL = 32 << 20, 24
#: Bytes of text that a Python worker takes apart at once (one longer text is taken whole); its arrays then fit a core's cache.
CHUNK_BYTES = 1 << 18
#: Bytes of an Arrow batch handed to a Python worker while a table is written.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master takes a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.gettempdir()}/llm-scratch"
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder and read again: they cut lineage and outlive executors.

    Every table has a path of its own. drop() removes those that no result needs any more; the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}
        atexit.register(self._delete, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        conf, key = self.spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        before = conf.get(key, None)
        conf.set(key, str(BATCH_BYTES))
        try:
            df.write.parquet(path)
        finally:
            conf.set(key, before) if before else conf.unset(key)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more, before it would collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm, context = self.spark._jvm, self.spark.sparkContext._jsc
        if jvm is None or context is None:
            return
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context.hadoopConfiguration()).delete(where, True)


def fits_broadcast(df: DataFrame, rows: int | None = None) -> bool:
    """Whether the counted rows of a written table of numbers stay under BROADCAST_BYTES."""
    return (df.count() if rows is None else rows) * CELL * len(df.columns) <= BROADCAST_BYTES


def by_ids(df: DataFrame, ids: DataFrame, on: list[str] | str, how: str = "left_semi") -> DataFrame:
    """Join of wide rows with a table of numbers: broadcast if the counted rows fit, else shuffled.

    Both ways give the same rows. ids should be a written table, since it is counted first.
    """
    return df.join(F.broadcast(ids) if fits_broadcast(ids) else ids, on, how)


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text together, null ids too; rows equal in both share it."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))


def without_keys(docs: DataFrame, drop: DataFrame, id_col: str, text_col: str, once: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose row_key isn't in drop (column key), with all their columns.

    Of rows that share a key of once (column key) one stays.
    """
    name = f"key_{uuid.uuid4().hex}"
    rows = docs.withColumn(name, row_key(id_col, text_col))
    rows = by_ids(rows, drop.select(F.col("key").alias(name)), name, "left_anti")
    if once is not None and not once.isEmpty():
        once = once.select(F.col("key").alias(name))
        one = by_ids(rows, once, name, "left_semi").dropDuplicates([name])
        rows = by_ids(rows, once, name, "left_anti").unionByName(one)
    return rows.drop(name)


class Bits:
    """A table of 64-bit hashes as 2 ** BITS bits by their leading bits, of fixed size: a filter with false positives only."""

    BITS = 26

    def __init__(self, ids: DataFrame, column: str):
        place = F.shiftrightunsigned(F.col(column), 64 - self.BITS)
        rows = ids.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(1 << 15))).alias("bits"))
        self.data = np.zeros(1 << (self.BITS - 3), np.uint8)
        for r in rows.toLocalIterator():
            self.data[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
        self.shared = ids.sparkSession.sparkContext.broadcast(self.data)

    def test(self):
        """A function to be called in tasks, from hashes to whether they may be in the table."""
        shared, shift = self.shared, np.uint64(64 - self.BITS)

        def run(h: np.ndarray) -> np.ndarray:
            at = h.view(np.uint64) >> shift
            return (shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

        return run


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column, without copies; null counts as the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most limit bytes together, or of one longer row."""
    buf, off = text_arrays(column)
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield at, end, buf[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def with_ids(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so extra columns with clashing names can't reach an operator's joins."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
