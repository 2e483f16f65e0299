"""Coverage as partial aggregates of an archive: kept with each change, merged where they are read.

A cell is a source and a UTC day (null: time unknown). Its rows give, for each pair of labels, how many available revisions
there are and their first and last time. An import adds rows of what is new in it. A least or a greatest time can't be taken
back, so a change of policy writes the cells anew that it touches, and no others: such rows are whole, and replace all that
earlier changes have said of their cell; a cell of which nothing is left gets one row of 0 messages. Readers take the last
whole rows of each cell and what was added since, keep the labels that a profile sees, and merge. They read cells, not
messages: as many as there are days with messages, however many those are.

Labels are in the rows, so one table serves every profile. Sources that are withdrawn are left out when reading, too.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.operators.archive import current_policy, lets_through

if TYPE_CHECKING:
    from chatlake.operators.store import Lake

SCHEMA = "source_id string, day long, scopes array<string>, sensitivity array<string>, messages long, first timestamp, last timestamp, whole boolean, seq long"
DAY = 86_400_000_000


def day_of(time: str) -> Column:
    """The number of the UTC day of a time, whatever the session's zone; days before 1970 are negative."""
    micros = F.unix_micros(time)
    return ((micros - F.pmod(micros, F.lit(DAY))) / F.lit(DAY)).cast("long")


def _labels(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(column, F.array().cast("array<string>"))))


def _cells(revisions: DataFrame, state: DataFrame) -> DataFrame:
    """One row a cell and pair of labels of the available ones of some revisions."""
    available = state.filter("available").select("revision_id", _labels("scopes").alias("scopes"), _labels("sensitivity").alias("sensitivity"))
    rows = revisions.select("revision_id", "source_id", "created_at", day_of("created_at").alias("day")).join(available, "revision_id")
    times = [F.min("created_at").alias("first"), F.max("created_at").alias("last")]
    return rows.groupBy("source_id", "day", "scopes", "sensitivity").agg(F.count(F.lit(1)).alias("messages"), *times)


def _rows(cells: DataFrame, whole: bool, seq: int) -> DataFrame:
    return cells.withColumns({"whole": F.lit(whole), "seq": F.lit(seq).cast("long")})


def added(new: DataFrame, state: DataFrame, seq: int) -> DataFrame:
    """What an import adds: partials of its new revisions, whose first policy rows are given."""
    return _rows(_cells(new, state), False, seq)


def touched(lake: Lake, changed: DataFrame, seq: int) -> DataFrame:
    """The cells of the revisions that get new policy rows, made anew as if the rows were in force."""
    own = changed.drop("version") if "version" not in changed.columns else current_policy(changed)
    revisions = lake.table("revisions").select("revision_id", "source_id", "created_at")
    revisions = revisions.withColumn("day", day_of("created_at"))
    where = revisions.join(own.select("revision_id"), "revision_id", "left_semi").select("source_id", "day").distinct()
    names = where.select(F.col("source_id").alias("of"), F.col("day").alias("on"))
    same = F.col("source_id").eqNullSafe(F.col("of")) & F.col("day").eqNullSafe(F.col("on"))
    state = lake.policy().join(own.select("revision_id"), "revision_id", "left_anti").unionByName(own)
    cells = _cells(revisions.join(names, same, "left_semi"), state)
    left = cells.select(F.col("source_id").alias("of"), F.col("day").alias("on")).distinct()
    kinds = {f.name: f.dataType for f in cells.schema}
    nothing = [F.lit(0 if n == "messages" else None).cast(kinds[n]).alias(n) for n in cells.columns if n not in ("source_id", "day")]
    empty = where.join(left, same, "left_anti").select("source_id", "day", *nothing)
    return _rows(cells.unionByName(empty), True, seq)


def scanned(lake: Lake, seq: int) -> DataFrame:
    """All cells from the revisions and the policy themselves, for an archive that lacks partials."""
    return _rows(_cells(lake.table("revisions"), lake.policy()), True, seq)


def complete(lake: Lake) -> bool:
    """Whether every change of revisions or policy has written its partials, or a later one has written all of them."""
    covers = max((j.get("partials", 0) for j in lake.jobs()), default=0)
    changes = [j for t in ("revisions", "policy") for j, _ in lake.parts(t, covers)]
    return all("partials" in j.get("tables", {}) for j in changes)


def merged(lake: Lake) -> DataFrame:
    """source_id, day, scopes, sensitivity, messages, first, last: what holds now of each cell and its labels."""
    cell = Window.partitionBy("source_id", "day")
    since = F.coalesce(F.max(F.when(F.col("whole"), F.col("seq"))).over(cell), F.lit(0))
    rows = lake.table("partials").withColumn("since", since).filter("seq >= since and messages > 0")
    times = [F.min("first").alias("first"), F.max("last").alias("last")]
    return rows.groupBy("source_id", "day", "scopes", "sensitivity").agg(F.sum("messages").alias("messages"), *times)


def summed(lake: Lake, seq: int) -> DataFrame:
    """All cells as whole rows: merged from the partials, or from the revisions where some change has none."""
    return _rows(merged(lake), True, seq) if complete(lake) else scanned(lake, seq)


def sources(lake: Lake, scopes: Sequence[str] | None = None, deny: Sequence[str] = (), classified: bool = False) -> DataFrame:
    """source_id, messages, first and last of what is visible by the limits of visible(), from partials alone."""
    rows = merged(lake).filter(lets_through(scopes, deny, classified))
    if lake.parts("sources"):
        rows = rows.join(lake.withdrawn_sources(), "source_id", "left_anti")
    return rows.groupBy("source_id").agg(F.sum("messages").alias("messages"), F.min("first").alias("first"), F.max("last").alias("last"))
