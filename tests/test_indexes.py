"""Inverted lists, the stored vector index, exact percentiles and the rate limiter against plain loops."""

import random
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlake.operators import evaluation, ivf, selection, semantic, vectors
from chatlake.streaming import limiter

T0 = datetime(2025, 3, 1, 9)


def near_by_hand(rows, queries, k):
    out = set()
    for q, v in queries:
        found = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), key) for key, x in rows)
        out |= {(q, key, i) for i, (_, key) in enumerate(found[:k], 1)}
    return out


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(5)
    centers = r.normal(size=(12, 8)) * 4
    rows = [(i, [float(x) for x in centers[i % 12 if i % 3 else 0] + r.normal(size=8)]) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(20)]  # the same vector again and again
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def test_exact_and_lists(spark, points, monkeypatch):
    rows, df = points
    asked = df.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = near_by_hand(rows, [(i, v) for i, v in rows if i % 9 == 0], 10)
    got = lambda found: {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()}
    monkeypatch.setattr(ivf, "LOT", 40)
    assert got(ivf.exact(df, asked, 10)) == want
    monkeypatch.setattr(ivf, "BLOCK", 50)
    centers = ivf.centroids(df, 12)
    held = ivf.blocks(ivf.dealt(df, centers), "vec_id")
    assert held.count() == len(rows) and held.groupBy("list").agg(F.max("block").alias("b")).agg(F.max("b")).first()[0] >= 1
    index = ivf.Index(held, centers, "vec_id", "embedding")
    assert got(ivf.search(index, asked, 10, 12)) == want  # as many probes as lists: exact
    probes = ivf.probes_for(index, 0.95, 10)
    few = ivf.recall(ivf.search(index, asked, 10, probes), ivf.exact(df, asked, 10)).first()
    assert probes < 12 and few.queries == len({q for q, _, _ in want}) >= 100 and few.recall >= 0.9
    assert ivf.search(index, asked.limit(0), 10, 2).count() == 0
    with pytest.raises(ValueError, match="lists"):
        ivf.centroids(df, 0)


def words(broken=False):
    """Counts of a few words as vectors; breaks down when told so. A class of its own, so that tasks get it by value."""

    class Words:
        model_id, dimension = "words", 4

        def embed(self, texts):
            if broken:
                raise RuntimeError("no model today")
            return [[float(t.count(w)) + 0.01 for w in ("tea", "boat", "sun", "x")] for t in texts]

    return Words()


def test_stored_vectors(spark, tmp_path):
    index, model = vectors.VectorIndex(spark, str(tmp_path / "index")), words()
    frame = lambda rows: spark.createDataFrame(rows, "revision_id string, text string")
    rows = [(f"r{i}", ("tea " if i % 3 else "boat ") * (1 + i % 5)) for i in range(40)]
    assert index.meta() is None
    done = vectors.update(index, frame(rows), model, T0, batch=15)
    assert done == {"embedded": 40, "batches": 3}
    assert semantic.index_state(index.meta(), vectors.wanted(model, 600, 100), 4, 40) is None
    assert vectors.update(index, frame(rows), model, T0)["embedded"] == 0
    changed = [("r0", "sun sun"), *rows[2:]]  # r0 changed, r1 gone
    with pytest.raises(Exception, match="no model"):
        vectors.update(index, frame(changed), words(broken=True), T0)
    assert {r.revision_id for r in index.state().collect()} == {f"r{i}" for i in range(2, 40)}  # stale ones are gone all the same
    assert vectors.update(index, frame(changed), model, T0)["embedded"] == 1
    best = vectors.search(index, ["sun"], model, 1).first()
    assert (best.revision_id, best["rank"]) == ("r0", 1)
    vectors.make_lists(index, 4, T0)
    assert sorted(r.revision_id for r in index.state().collect()) == sorted(r for r, _ in changed)
    near = lambda probes: [(r.query_id, r.revision_id) for r in vectors.search(index, ["sun", "boat boat"], model, 3, probes).orderBy("query_id", "rank").collect()]
    assert near(4) == near(None) and near(2)[0] == (0, "r0")
    vectors.update(index, frame([*changed, ("new", "sun boat")]), model, T0)
    assert index.alive("vectors").filter("revision_id = 'new'").first()["list"] is not None  # dealt to the lists there are
    vectors.convert(index, "int8", T0)
    assert index.meta()["packing"] == "int8" and index.alive("packed").count() == 40
    vectors.purge(index, frame([("r0", "")]), T0)
    assert vectors.purge(index, frame([("r0", "")]), T0) is None
    assert index.alive("packed").filter("revision_id = 'r0'").count() == 0 and ("r0" not in {r for _, r in near(None)})
    assert vectors.update(index, frame([*changed, ("new", "sun boat")]), model, T0)["embedded"] == 1  # it comes back when it is wanted again
    vectors.convert(index, "none", T0)
    assert index.meta()["packing"] == "none"
    with pytest.raises(ValueError, match="another model"):
        vectors.update(index, frame(rows), model, T0, size=10)


def test_commits_of_a_run_are_bounded(spark, tmp_path):
    index = vectors.VectorIndex(spark, str(tmp_path / "index"))
    rows = spark.createDataFrame([(f"r{i}", "tea") for i in range(60)], "revision_id string, text string")
    assert vectors.update(index, rows, words(), T0, batch=1) == {"embedded": 60, "batches": vectors.COMMITS}
    assert index.alive("vectors").select("revision_id").distinct().count() == 60 == index.alive("vectors").count()


def test_broken_run_goes_on(spark, tmp_path, monkeypatch):
    index, model, runs = vectors.VectorIndex(spark, str(tmp_path / "index")), words(), []
    rows = spark.createDataFrame([(f"r{i}", "tea") for i in range(60)], "revision_id string, text string")
    plain = semantic.embedded

    def breaks(chunks, provider):
        runs.append(1)
        if len(runs) == 3:
            raise RuntimeError("power cut")
        return plain(chunks, provider)

    monkeypatch.setattr(semantic, "embedded", breaks)
    with pytest.raises(RuntimeError, match="power cut"):
        vectors.update(index, rows, model, T0, batch=15)
    held = index.state().count()
    assert 0 < held < 60 and index.meta()["built_at"] is None
    assert vectors.update(index, rows, model, T0, batch=15)["embedded"] == 60 - held
    assert index.alive("vectors").count() == 60 and index.meta()["built_at"]


def test_percentiles(spark, monkeypatch):
    r = random.Random(3)
    groups = {"a": [r.random() for _ in range(3000)], "b": [float(r.randrange(3)) for _ in range(2000)], None: [5.0] * 1500, "c": [1.0, 2.0], "d": [r.expovariate(1) ** 9 * r.choice([-1, 1]) for _ in range(4001)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    monkeypatch.setattr(selection, "SELECTED", 40)
    shares = [0.0, 0.001, 0.5, 0.95, 0.99, 1.0]
    got = {(x.g, x.share): x.value for x in selection.percentiles(df, "v", shares, ["g"]).collect()}
    assert got == {(g, s): sorted(vs)[round(s * (len(vs) - 1))] for g, vs in groups.items() for s in shares}
    monkeypatch.setattr(selection, "ACCURACY", 20)  # sketches that err cost rounds, not the result
    every = [v for vs in groups.values() for v in vs]
    assert [x.value for x in selection.percentiles(df, "v", [0.9]).collect()] == [sorted(every)[round(0.9 * (len(every) - 1))]]
    assert evaluation.percentile(df, "v", 0.5, ["g"]).filter("g = 'a'").first().value == sorted(groups["a"])[1500]
    assert selection.percentiles(df.filter("false"), "v", [0.5], ["g"]).count() == 0


def test_no_task_sorts_a_large_group(spark, monkeypatch):
    """What is collected into one list never exceeds SELECTED."""
    monkeypatch.setattr(selection, "SELECTED", 100)
    df = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    own, seen = selection.Selection(df, "v", ["g"]), []
    plain = own.narrowed
    own.narrowed = lambda left: [seen.append(b.n) or b for b in plain(left)]
    assert {x.share: x.value for x in own.large([0.5, 0.95]).collect()} == {0.5: 10_000.0 if round(0.5 * 19_999) == 10_000 else 9_999.0, 0.95: float(round(0.95 * 19_999))}
    assert seen and min(seen) <= 100 and own.small([0.5]).count() == 0


def allowed_by_hand(requests, most, seconds):
    out, held = {}, {}
    for key, at, i in sorted(requests, key=lambda x: (x[0] or "", x[1], x[2])):
        times = held.setdefault(key, deque())
        while times and (at - times[0]).total_seconds() > seconds:
            times.popleft()
        out[i] = len(times) < most
        if out[i]:
            times.append(at)
    return out


def requests():
    r = random.Random(2)
    rows = [("k", T0 + timedelta(seconds=s), i) for i, s in enumerate((0, 1, 50, 61, 62))]
    for key in ("a", "b", None, "hot"):
        rows += [(key, T0 + timedelta(seconds=r.randrange(900)), len(rows) + i) for i in range(300 if key == "hot" else 60)]
    return [(k, t, i) for i, (k, t, _) in enumerate(rows)]


def test_limiter(spark):
    rows = requests()
    df = spark.createDataFrame(rows, "key string, at timestamp, id long").repartition(3)
    got = {r.id: r.allowed for r in limiter.limited(df, 2, 60, tie="id").collect()}
    assert got == allowed_by_hand(rows, 2, 60)
    assert [got[i] for i in range(5)] == [True, True, False, True, True]  # refused ones don't count
    assert limiter.limited(df.filter("false"), 2).count() == 0
    window = limiter.Window(2, 60)
    assert [window.allow(s * 1_000_000) for s in (0, 1, 50, 61, 62)] == [True, True, False, True, True] and len(window.times) == 2


def test_limiter_on_a_stream(spark, tmp_path):
    """The same in three runs of a stream, each going on where the one before has stopped."""
    rows = sorted((x for x in requests() if x[0]), key=lambda x: (x[1], x[2]))
    for part in range(3):
        own = rows[part * len(rows) // 3 : (part + 1) * len(rows) // 3]
        spark.createDataFrame(own, "key string, at timestamp, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, at timestamp, id long").parquet(str(tmp_path / "in"))
        out = limiter.limited_stream(stream, 2, 60).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == allowed_by_hand(rows, 2, 60)


def test_sessions_of_a_stream(spark, tmp_path):
    times = [("a", 0), ("a", 20), ("a", 100), ("b", 5), ("b", 3000), ("a", 9000)]
    rows = [(k, T0 + timedelta(seconds=s)) for k, s in times]
    spark.createDataFrame(rows, "key string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limiter.sessions_stream(spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in")), "60 seconds", "10 seconds")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.key, (r.start - T0).total_seconds(), (r["last"] - T0).total_seconds(), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0, 20, 2), ("a", 100, 100, 1), ("b", 5, 5, 1), ("b", 3000, 3000, 1)}  # the last one is still open
