"""Notes: which files count, their titles and headings, exact search with snippets, and pages of lines.

Notes come from sources.notes: path (relative), revision, text. All but the per-character normal form is done in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions.text import has_credentials, mask_credentials, normal, normal_map, normalize

#: Names of files that look like credentials; they are never shown.
CREDENTIAL_NAMES = r"(?i)(^|/)(\.env[^/]*|[^/]*(secret|credential|password|token|api[_-]?key|id_rsa|\.pem)[^/]*)$"
#: A heading in either of Markdown's forms.
_ATX, _UNDER = r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", r"^ {0,3}(=+|-+)[ \t]*$"


def glob_pattern(glob: str) -> str:
    """A regular expression for a path, or for one below it: ** crosses folders, * and ? don't; a bare name fits at any depth."""
    g = glob.strip("/")
    body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", g))
    return rf"^{'' if '/' in g else '(?:.*/)?'}{body}(?:/.*)?$"


def safe(path: Column) -> Column:
    """Relative paths without empty, dot or parent parts, drive letters and null characters."""
    return (path != "") & ~path.rlike(r"(?s)^[/~]|^[A-Za-z]:|(^|/)\.{0,2}(/|$)|\x00|\\")


def listed(notes: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), max_files: int | None = None) -> DataFrame:
    """The notes that patterns let through, by path; an excluded folder hides all below it. max_files keeps the first ones."""
    own = F.col("path")
    rows = notes.filter(safe(own) & ~own.rlike(CREDENTIAL_NAMES) & F.lower(own).endswith(".md"))
    if include:
        rows = rows.filter(own.rlike("|".join(map(glob_pattern, include))))
    if exclude:
        rows = rows.filter(~own.rlike("|".join(map(glob_pattern, exclude))))
    return rows if max_files is None else rows.orderBy("path").limit(max_files)


def headings(notes: DataFrame) -> DataFrame:
    """path, line (from 1), level and heading of each note, in both of Markdown's forms; fenced code has none."""
    lines = notes.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    w = Window.partitionBy("path").orderBy("i")
    fence = F.col("line").rlike(r"^ {0,3}(```|~~~)")
    lines = lines.withColumns({"inside": F.sum(fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2 == 1, "next": F.lead("line").over(w)}).filter(~F.col("inside") & ~fence)
    atx = F.col("line").rlike(_ATX)
    under = ~atx & (F.trim("line") != "") & F.coalesce(F.col("next").rlike(_UNDER), F.lit(False))
    level = F.when(atx, F.length(F.regexp_extract("line", _ATX, 1))).otherwise(F.when(F.ltrim("next").startswith("="), 1).otherwise(2))
    return lines.filter(atx | under).select("path", (F.col("i") + 1).alias("line"), level.cast("long").alias("level"), F.when(atx, F.regexp_extract("line", _ATX, 2)).otherwise(F.trim("line")).alias("heading"))


def titles(notes: DataFrame) -> DataFrame:
    """path and title: the first heading of the first level, else the file's name."""
    first = headings(notes).filter("level = 1").groupBy("path").agg(F.min_by("heading", "line").alias("h"))
    return notes.select("path").join(first, "path", "left").select("path", F.coalesce("h", F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)).alias("title"))


def bounded(text: str, start: int, end: int, size: int) -> str:
    """A window of at most size characters around a match, its marks included."""
    if len(text) <= size:
        return text
    room = max(1, size - (start > 0) - (end < len(text)))
    left = start if end - start >= room else max(0, start - (room - (end - start)) // 2)
    right = min(len(text), left + room)
    left = max(0, right - room) if end - start < room else left
    return ("…" * (left > 0) + text[left:right] + "…" * (right < len(text)))[:size]


def _window(size: int, first: str):
    @F.pandas_udf("struct<snippet:string,start:int,end:int>")
    def run(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            made, offsets = normal_map(t)
            at = made.find(first)
            a, b = offsets[at], offsets[min(at + len(first), len(offsets) - 1)]
            out.append((bounded(t, a, b, size), a, b))
        return pd.DataFrame(out, columns=["snippet", "start", "end"])

    return run


def search(notes: DataFrame, query: str, mode: str = "literal", limit: int = 20, width: int = 200, budget: int | None = None, redact: bool = False) -> DataFrame:
    """path, revision, title, lines and snippet of the first match in each note, by path; snippets are cut where a budget ends.

    The texts' normal form decides; notes that hold a known credential are left out, or masked if redact.
    """
    terms = [normal(query)] if mode == "literal" else list(dict.fromkeys(normal(query).split()))
    if not terms or not terms[0]:
        raise ValueError("the query is empty")
    rows = notes.withColumn("text", mask_credentials("text")) if redact else notes.filter(~has_credentials(F.col("text")))
    rows = rows.withColumn("search_text", F.col("search_text") if "search_text" in notes.columns else normalize("text"))
    for t in terms:
        rows = rows.filter(F.col("search_text").contains(t))
    page = rows.orderBy("path").limit(limit).withColumn("w", _window(width, terms[0])("text"))
    at = lambda c: (F.length(F.substring(F.col("text"), F.lit(1), F.col(c))) - F.length(F.replace(F.substring(F.col("text"), F.lit(1), F.col(c)), F.lit("\n"))) + 1).cast("long")
    page = page.select("path", "revision", "text", F.col("w.snippet").alias("snippet"), at("w.start").alias("line_start"), at("w.end").alias("line_end"))
    page = page.join(titles(page), "path").drop("text")
    if budget is not None:
        before = F.coalesce(F.sum(F.length("snippet")).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of a page
        page = page.withColumn("snippet", F.substring(F.col("snippet"), F.lit(1), F.greatest(F.lit(0), F.lit(budget) - before).cast("int")))
    return page.orderBy("path")


def note(notes: DataFrame, path: str, revision: str | None = None, start: int = 1, lines: int = 200) -> dict:
    """A page of a note's lines; a reference to another revision than the present one is an error."""
    row = notes.filter(F.col("path") == path).select("path", "revision", "text").first()
    if row is None:
        raise LookupError("no such note")
    if revision is not None and revision != row["revision"]:
        raise ValueError("the reference is out of date")
    every = re.split(r"\r?\n", row["text"])
    end = min(len(every), start - 1 + lines)
    near = headings(notes.filter(F.col("path") == path)).filter(F.col("line") <= start).agg(F.max_by("heading", "line").alias("h")).first()
    return {"path": path, "revision": row["revision"], "lines": every[max(0, start - 1) : end], "start": start, "next": end + 1 if end < len(every) else None, "of": len(every), "heading": near["h"]}
