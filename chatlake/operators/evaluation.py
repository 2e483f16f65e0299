"""Measuring: a suite of cases against an archive, latency figures, a synthetic corpus, and what a crawl should fetch next."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.operators import selection

# Gates that a suite must pass, shape of the synthetic corpus.
GATES = {"recall": 0.90, "citations": 1.0, "refusals": 1.0}
START, CONVERSATION_SECONDS, STEP, SPREAD = 1754035200, 600, 60, 7
# End of the fixed values.
TOPICS = ("sailing", "gardens", "tax", "travel", "code", "music")
CASE_TYPES = ("search", "get_event", "refusal")


def load_suite(text: str) -> dict:
    """A suite from JSON; what doesn't fit its form is an error that names it."""
    suite = json.loads(text)
    for key in ("schema_version", "name", "cases"):
        if key not in suite:
            raise ValueError(f"the suite has no {key}")
    seen = set()
    for case in suite["cases"]:
        if case.get("type") not in CASE_TYPES or not case.get("id") or case["id"] in seen:
            raise ValueError(f"a case is of no known type or has no id of its own: {case.get('id')}")
        if case["type"] == "search" and not case.get("query") or case["type"] == "get_event" and not case.get("event_id"):
            raise ValueError(f"case {case['id']} asks for nothing")
        seen.add(case["id"])
    return suite


def preconditions(messages: DataFrame, suite: dict) -> list[str]:
    """What the suite needs and the archive lacks: events, and a least number of messages."""
    wanted = {e for c in suite["cases"] for e in c.get("acceptable_event_ids", [])}
    held = {r["event_id"] for r in messages.filter(F.col("event_id").isin(*wanted)).select("event_id").distinct().collect()} if wanted else set()
    least = suite.get("requires", {}).get("messages", 0)
    return [f"no event {e}" for e in sorted(wanted - held)] + ([f"fewer than {least} messages"] if least and messages.limit(least).count() < least else [])


def run_case(case: dict, search: Callable[..., dict], get_event: Callable[[str], dict]) -> dict:
    """recall, answered, refused, forbidden and citations of one case."""
    wanted, banned = set(case.get("acceptable_event_ids", [])), set(case.get("forbidden_event_ids", []))
    try:
        if case["type"] == "get_event":
            rows = [get_event(case["event_id"])]
        else:
            rows = search(case["query"], mode=case.get("match_mode", "literal"), order=case.get("order", "relevance"))["results"]
    except (LookupError, ValueError):
        rows = []
    got = {r["event_id"] for r in rows}
    cited = [r.get("citation", "").startswith("pb:") and ":r" in r["citation"] for r in rows]
    refuse = case["type"] == "refusal" or case.get("expected_access") == "denied"
    return {"id": case["id"], "recall": len(got & wanted) / len(wanted) if wanted else None, "answered": bool(rows), "refused": not rows if refuse else None, "forbidden": bool(got & banned), "citations": sum(cited) / len(cited) if cited else None}


def run_suite(suite: dict, search: Callable[..., dict], get_event: Callable[[str], dict]) -> dict:
    """Every case, the means, and whether all gates hold."""
    rows = [run_case(c, search, get_event) for c in suite["cases"]]
    mean = lambda key: (lambda v: sum(v) / len(v) if v else None)([float(r[key]) for r in rows if r[key] is not None])
    found = {"recall": mean("recall"), "citations": mean("citations"), "refusals": mean("refused"), "answered": mean("answered"), "forbidden": any(r["forbidden"] for r in rows)}
    return found | {"cases": rows, "passed": not found["forbidden"] and all(found[k] is None or found[k] >= v for k, v in GATES.items())}


def metrics(results: DataFrame) -> DataFrame:
    """The same means of a table of case results."""
    return results.agg(F.avg("recall").alias("recall"), F.avg("citations").alias("citations"), F.avg(F.col("refused").cast("double")).alias("refusals"), F.avg(F.col("answered").cast("double")).alias("answered"), F.coalesce(F.bool_or("forbidden"), F.lit(False)).alias("forbidden"))


def percentile(rows: DataFrame, value: str, share: float, by: Sequence[str] = ()) -> DataFrame:
    """by and value: one nearest-rank percentile; see selection.percentiles()."""
    return selection.percentiles(rows, value, [share], by).drop("share")


def percentile_of(values: Sequence[float], share: float) -> float:
    return sorted(values)[round(share * (len(values) - 1))]


def latency(values: Sequence[float]) -> dict[str, float]:
    return {"p50": percentile_of(values, 0.5), "p95": percentile_of(values, 0.95), "p99": percentile_of(values, 0.99), "max": max(values), "mean": sum(values) / len(values)}


def timed(run: Callable[[], object], warm: int = 2, repeats: int = 20) -> dict[str, float]:
    """Seconds of a call after warm-up calls."""
    took = []
    for i in range(warm + repeats):
        began = time.perf_counter()
        run()
        if i >= warm:
            took.append(time.perf_counter() - began)
    return latency(took)


def growth(curve: DataFrame, warm_seconds: float) -> DataFrame:
    """worker and the ratio of its last memory to its first one after the warm-up; curve: worker, at (seconds), rss."""
    warm = curve.filter(F.col("at") >= warm_seconds)
    return warm.groupBy("worker").agg((F.max_by("rss", "at") / F.min_by("rss", "at")).alias("growth"))


def drift(samples: DataFrame) -> DataFrame:
    """P95 of the last tenth of each worker's samples over that of its first tenth; samples: worker, at, seconds."""
    w = Window.partitionBy("worker")
    placed = samples.withColumns({"_i": F.row_number().over(w.orderBy("at")), "_n": F.count(F.lit(1)).over(w)})
    part = F.when(F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10)), "first").when(F.col("_i") > F.col("_n") - F.greatest(F.lit(1), F.floor(F.col("_n") / 10)), "last")
    p95 = percentile(placed.withColumn("part", part).filter("part is not null"), "seconds", 0.95, ["worker", "part"])
    return p95.groupBy("worker").agg((F.max(F.when(F.col("part") == "last", F.col("value"))) / F.max(F.when(F.col("part") == "first", F.col("value")))).alias("drift"))


def synthetic(spark: SparkSession, conversations: int, messages: int, seed: int = 7) -> DataFrame:
    """A corpus by rule: conversation, node, position, speaker, created_at and text; any size, in parallel."""
    n = spark.range(conversations * messages).select((F.col("id") / messages).cast("long").alias("cid"), (F.col("id") % messages).alias("mid"))
    topic = F.element_at(F.array(*map(F.lit, TOPICS)), ((F.col("cid") + F.col("mid")) % len(TOPICS) + 1).cast("int"))
    number = F.lpad(F.pmod(F.xxhash64("cid", "mid", F.lit(seed)), F.lit(1_000_000)).cast("string"), 6, "0")
    at = F.lit(START) + F.col("cid") * CONVERSATION_SECONDS + F.col("mid") * STEP + (F.col("mid") / SPREAD).cast("long") * (SPREAD * (SPREAD - 1) // 2) + (F.col("mid") % SPREAD) * (F.col("mid") % SPREAD + 1) / 2
    return n.select(
        F.format_string("bench-%05d", "cid").alias("conversation"), F.format_string("m-%d-%d", "cid", "mid").alias("node"), F.col("mid").alias("position"), F.when(F.col("mid") % 3 == 1, "assistant").otherwise("owner").alias("speaker"),
        F.timestamp_seconds(at).alias("created_at"), F.concat(F.when(F.col("mid") == 0, "Hello. ").otherwise(""), F.lit("About "), topic, F.lit(" number "), number).alias("text"),
    )


# A collector of changed items: items have id, updated; state has id, updated of what was fetched.


def to_crawl(items: DataFrame, waterline: float, most: int = 20) -> DataFrame:
    """The oldest changed items above the high-water mark."""
    return items.filter(F.col("updated") > waterline).orderBy("updated", "id").limit(most)


def next_waterline(fetched: DataFrame, waterline: float) -> float:
    top = fetched.agg(F.max("updated")).first()[0]
    return waterline if top is None else max(waterline, top)


def to_fetch(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items that aren't held as they are now."""
    return items.join(state.select("id", "updated"), ["id", "updated"], "left_anti")


def backfill(items: DataFrame, state: DataFrame, before: float, most: int = 20) -> DataFrame:
    """The newest items below a mark that are held in no state at all; the next mark is the least of them."""
    return items.filter(F.col("updated") < before).join(state.select("id").distinct(), "id", "left_anti").orderBy(F.col("updated").desc(), "id").limit(most)


def batches(items: DataFrame, most_bytes: int, size: str = "bytes", order: str = "id") -> DataFrame:
    """batch numbers such that a batch holds at most so many bytes, or one larger item.

    Runs of the order are dealt to batches by the running sum, so it needs no loop over items.
    """
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of an outbox, as many rows as it holds
    return items.withColumn("batch", F.floor((F.sum(size).over(w) - F.col(size)) / most_bytes))


def retry_after(failures: int, base: float = 60.0, most: float = 3600.0) -> float:
    return min(most, base * 2 ** max(0, failures - 1))
