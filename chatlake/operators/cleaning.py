"""Takes text that tools have put into conversations out of an archive: a plan first, then a backup and one withdrawal."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators import rules, store
from chatlake.operators.store import Lake

#: What the reason of a withdrawal by a rule begins with.
REASON = "cleaned: "


def planned(lake: Lake, sessions: DataFrame | None = None, threads: DataFrame | None = None) -> DataFrame:
    """event_id, source, conversation, rule, chars and text of what the rules would withdraw; changes nothing."""
    namespace = F.element_at(F.split("event_id", ":"), 2)
    messages = lake.messages().withColumn("source", rules.source_type(namespace, F.col("conversation")))
    return rules.plan(messages, sessions, threads)


def apply(lake: Lake, folder: str, now: datetime, sessions: DataFrame | None = None, threads: DataFrame | None = None) -> dict:
    """Withdraws what the plan names, each event with its rule as the reason, after a backup that has been checked.

    The plan is made of one state of the archive. Doing it again finds nothing more, and then makes no backup either.
    """
    found = planned(lake.snapshot(), sessions, threads).select("event_id", "rule").distinct()
    n = found.select("event_id").distinct().count()
    if not n:
        return {"events": 0, "backup": None}
    path = store.backup(lake, folder, now)["path"]
    if not store.backup_check(lake.spark, path):
        raise RuntimeError("the backup isn't sound, so nothing was withdrawn")
    store.withdraw_events(lake, found.select("event_id", F.concat(F.lit(REASON), "rule").alias("reason")), now)
    return {"events": n, "backup": path}
