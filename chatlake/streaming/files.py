"""Files that have changed since they were last imported: a ledger of path, length and time, compared by an anti join."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators.commits import Log

SCHEMA = "path string, length long, modified timestamp, seq long"
#: Files handed to an import at once.
MOST = 1_000


class Ledger(Log):
    """A row for each file and state that was imported; a file's last one says what it was like."""

    def seen(self) -> DataFrame:
        paths = self.folders("files")
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        last = F.max_by(F.struct("length", "modified"), "seq").alias("s")
        return rows.groupBy("path").agg(last).select("path", "s.*")


def changed(ledger: Ledger, folder: str) -> DataFrame:
    """path, length and modified of files that are new, or longer, shorter or later than when they were imported."""
    there = ledger.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)  # contents aren't read
    there = there.select("path", "length", F.col("modificationTime").alias("modified"))
    return there.join(ledger.seen(), ["path", "length", "modified"], "left_anti")


def digest(rows: Sequence) -> str:
    """The same files in the same state always have the same digest."""
    return hashlib.sha256("\n".join(f"{r['path']}|{r['length']}|{r['modified'].isoformat()}" for r in rows).encode()).hexdigest()


def import_changed(ledger: Ledger, folder: str, publish: Callable[[list[str], str], object], now: datetime, most: int = MOST) -> list[list[str]]:
    """Hands changed files to publish(paths, digest), oldest first, at most so many at once, and enters them in the ledger.

    An import that breaks off before it is entered comes again with the same digest, so a publish that knows the digests it
    has imported (as an archive does) takes nothing twice. Returns the files of each import.
    """
    done = []
    while rows := changed(ledger.snapshot(), folder).orderBy("modified", "path").limit(most).collect():
        publish([r["path"] for r in rows], digest(rows))

        def enter(base: Ledger, job: dict, rows: list = rows) -> tuple[dict, dict[str, DataFrame]]:
            own = [(r["path"], r["length"], r["modified"], job["seq"]) for r in rows]
            return {}, {"files": base.spark.createDataFrame(own, SCHEMA)}

        ledger.change(enter, "files", now)
        done.append([r["path"] for r in rows])
    return done
