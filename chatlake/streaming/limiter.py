"""A sliding-window rate limiter as a state machine, over tables and over streams; and sessions of a stream.

A request is allowed if fewer than `most` allowed ones lie within the seconds before it, both ends included; refused ones
don't count. A key's state is the times of its allowed requests that still count, so it never holds more than `most`.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType


class Window:
    def __init__(self, most: int, seconds: float, times: Iterator[int] | tuple[int, ...] = ()):
        self.most, self.micros, self.times = most, int(seconds * 1_000_000), deque(times)

    def allow(self, at: int) -> bool:
        """at: microseconds, not before the last one's."""
        while self.times and at - self.times[0] > self.micros:
            self.times.popleft()
        if len(self.times) >= self.most:
            return False
        self.times.append(at)
        return True


def limited(requests: DataFrame, most: int, seconds: float = 60, key: str = "key", at: str = "at", tie: str | None = None) -> DataFrame:
    """requests with allowed, each key's in the order of time (then tie).

    Keys are dealt to tasks and rows sorted there, so a task passes through its rows and holds one key's window. A key by
    itself is a sequence: whether a request is allowed depends on all before it.
    """
    schema = StructType([*requests.schema.fields, StructField("allowed", BooleanType())])
    arrow = to_arrow_schema(schema)
    order = [key, "_at", *([tie] if tie else [])]
    rows = requests.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp"))).repartition(key).sortWithinPartitions(*order)
    names = requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, window = object(), Window(most, seconds)
        for batch in batches:
            out = []
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            for k, t in zip(keys, batch.column(batch.schema.get_field_index("_at")).to_pylist(), strict=True):
                if k != who:
                    who, window = k, Window(most, seconds)
                out.append(window.allow(t))
            columns = [batch.column(batch.schema.get_field_index(c)).cast(arrow.field(c).type) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.bool_())], schema=arrow)

    return rows.mapInArrow(run, schema)


def limited_stream(requests: DataFrame, most: int, seconds: float = 60, late: str = "1 hour") -> DataFrame:
    """A stream of requests (key, at, id: longs and a timestamp) with allowed.

    The requests of a micro-batch are taken in the order of time, then id; the state outlives it, and goes once the watermark
    has passed the last time that counts.
    """
    out = StructType([*requests.select("key", "at", "id").schema.fields, StructField("allowed", BooleanType())])

    def step(keys: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["at", "id"], kind="stable")
        window = Window(most, seconds, tuple(held.get[0]) if held.exists else ())
        allowed = [window.allow(int(t.value) // 1000) for t in pd.to_datetime(rows["at"], utc=True).astype("datetime64[ns, UTC]")]
        held.update((list(window.times),))
        if window.times:
            held.setTimeoutTimestamp(max(window.times[-1] // 1000 + int(seconds * 1000), held.getCurrentWatermarkMs()) + 1)
        yield rows[["key", "at", "id"]].assign(allowed=allowed)

    keyed = requests.select("key", "at", "id").withWatermark("at", late).groupBy("key")
    return keyed.applyInPandasWithState(step, out, "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def sessions_stream(events: DataFrame, gap: str, late: str, time: str = "at", key: str = "key") -> DataFrame:
    """key, start, last and n of the sessions of a stream; a pause of the gap or longer ends one. Given out once it is over."""
    by = F.session_window(time, gap)
    rows = events.withWatermark(time, late).groupBy(key, by.alias("s"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last")).select(key, F.col("s.start").alias("start"), "last", "n")
