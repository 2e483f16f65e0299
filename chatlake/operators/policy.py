"""Policy as an append-only log: who may see what is the last row of each revision, and only that.

Rows: revision_id, version, available, scopes, sensitivity, classification, recorded_at, reason. Every change appends rows
of one new version (the epoch); nothing is rewritten, so a reader that holds a version sees one state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators.archive import current_policy

SCHEMA = "revision_id string, version long, available boolean, scopes array<string>, sensitivity array<string>, classification string, recorded_at timestamp, reason string"

#: Rows by source: a source's last one says whether it is withdrawn.
SOURCES = "source_id string, version long, withdrawn boolean, recorded_at timestamp, reason string"


def _empty() -> Column:
    return F.array().cast("array<string>")


def _current(log: DataFrame) -> DataFrame:
    """The current rows of a log, or of what are current rows already (without a version)."""
    return current_policy(log) if "version" in log.columns else log


def initial(revisions: DataFrame, epoch: int, now: datetime | Column, withdrawn: DataFrame | None = None) -> DataFrame:
    """The first row of new revisions: available and unclassified, but withdrawn where their event or source is.

    withdrawn has event_id, source_id, either null.
    """
    rows = revisions.select("revision_id", "event_id", "source_id")
    gone = F.lit(False)
    if withdrawn is not None:
        for key in ("event_id", "source_id"):
            marks = withdrawn.filter(F.col(key).isNotNull()).select(key, F.lit(True).alias(f"gone_{key}")).distinct()
            rows = rows.join(marks, key, "left")
            gone = gone | F.coalesce(f"gone_{key}", F.lit(False))
    at = now if isinstance(now, Column) else F.lit(now)
    return rows.select("revision_id", F.lit(epoch).cast("long").alias("version"), (~gone).alias("available"), _empty().alias("scopes"), _empty().alias("sensitivity"), F.lit("unclassified").alias("classification"), at.alias("recorded_at"), F.when(gone, "inherited").alias("reason"))


def epoch_of(log: DataFrame) -> int:
    return log.agg(F.max("version")).first()[0] or 0


def withdraw(log: DataFrame, revisions: DataFrame, epoch: int, now: datetime, reason: str | Column = "withdrawn", event: str | None = None, source: str | None = None, events: DataFrame | None = None) -> DataFrame:
    """Rows to append that withdraw the available revisions of an event, a source, or a table of event_id and reason.

    Labels aren't copied. What is withdrawn already gets no row, so doing it again changes nothing.
    """
    rows = revisions.select("revision_id", "event_id", "source_id")
    if event is not None:
        rows = rows.filter(F.col("event_id") == event)
    if source is not None:
        rows = rows.filter(F.col("source_id") == source)
    why = F.lit(reason) if isinstance(reason, str) else reason
    if events is not None:
        rows, why = rows.join(events.groupBy("event_id").agg(F.min("reason").alias("why")), "event_id"), F.col("why")
    rows = rows.join(_current(log).filter("available").select("revision_id"), "revision_id", "left_semi")
    return rows.select("revision_id", F.lit(epoch).cast("long").alias("version"), F.lit(False).alias("available"), _empty().alias("scopes"), _empty().alias("sensitivity"), F.lit("unclassified").alias("classification"), F.lit(now).alias("recorded_at"), why.alias("reason"))


def relabel(log: DataFrame, revisions: DataFrame, epoch: int, now: datetime, scopes: Sequence[str], sensitivity: Sequence[str], event: str | None = None, source: str | None = None) -> DataFrame:
    """Rows to append that replace the labels of an event's or a source's available revisions; withdrawn ones stay so."""
    rows = revisions.select("revision_id", "event_id", "source_id")
    rows = rows.filter(F.col("event_id") == event) if event is not None else rows.filter(F.col("source_id") == source)
    rows = rows.join(_current(log).filter("available").select("revision_id"), "revision_id", "left_semi")
    if rows.isEmpty():
        raise ValueError("nothing to label: unknown or withdrawn")
    values = lambda xs: F.array(*map(F.lit, sorted(set(xs)))).cast("array<string>")
    return rows.select("revision_id", F.lit(epoch).cast("long").alias("version"), F.lit(True).alias("available"), values(scopes).alias("scopes"), values(sensitivity).alias("sensitivity"), F.lit("classified").alias("classification"), F.lit(now).alias("recorded_at"), F.lit("labelled").alias("reason"))


def profile_filters(profile: dict) -> dict:
    """The keyword arguments of visible() that a trusted profile makes mandatory: * lifts the limit of scopes."""
    allow = profile.get("allow_scopes", [])
    return {"scopes": None if "*" in allow else list(allow), "deny": list(profile.get("deny_sensitivity", [])), "classified": not profile.get("allow_unclassified", False)}


class Unsettled(RuntimeError):
    pass


def with_epoch_retry(epoch: Callable[[], int], work: Callable[[], object], attempts: int = 3) -> object:
    """The result of work() during which the policy didn't change; after as many attempts an error."""
    for _ in range(attempts):
        before = epoch()
        out = work()
        if epoch() == before:
            return out
    raise Unsettled("the policy kept changing")
