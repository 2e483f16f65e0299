"""Queries over small tables of their own that hold what the given ones rarely do, against their SQL."""

import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from chatlake.functions import text as X
from chatlake.operators import archive, ivf, semantic, store
from chatlake.plans import lakes, more
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
CONVERSATIONS = "conv_id long, turn int, role string, text string"


def same_as_sql(spark, d, name, **tables):
    duckdb = pytest.importorskip("duckdb")
    engine = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{d}/{table}.parquet")
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{d}/{table}.parquet/*.parquet')")
    found = (lakes.QUERIES | more.QUERIES)[name](spark, str(d))
    columns = ", ".join(f'"{c}"' for c in found.columns)
    want = engine.execute(f"SELECT {columns} FROM ({(lakes.SQL | more.SQL)[name]})").fetchall()
    assert want and sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_edits_are_later_than_what_they_edit(spark):
    late = lakes.NOW + timedelta(days=3)
    rows = spark.createDataFrame([("a", T0), ("b", lakes.NOW), ("c", late)], "text string, created_at timestamp")
    assert {r.text[0]: r.updated_at for r in lakes.edited(rows).collect()} == {"a": lakes.NOW, "b": lakes.NOW + timedelta(seconds=1), "c": late + timedelta(seconds=1)}


def test_import_of_late_messages(spark, tmp_path):
    rows = [(c, t, "user", f"text {c} {t}") for c in (2, 3, 3648, 3649, 3650) for t in range(2)]  # 3648 hours from T0 is NOW
    same_as_sql(spark, tmp_path, "lake_import", conversations=spark.createDataFrame(rows, CONVERSATIONS))


def test_restored_words_in_capitals(spark, tmp_path):
    texts = ["The end", "THE end", "the end", "an end"]
    rows = [(c, t, "user", texts[t]) for c in (1, 3) for t in range(4)]
    same_as_sql(spark, tmp_path, "lake_restored", conversations=spark.createDataFrame(rows, CONVERSATIONS))


def test_claims_with_letters_that_capitals_lose(spark, tmp_path):
    rows = [(i, f"{w} of the {w} number {i}") for i, w in enumerate(["Straße", "Maß", "ﬁsh", "Öl", "ıs", "tea"])]
    same_as_sql(spark, tmp_path, "claims_stored", benchmark=spark.createDataFrame(rows, "item_id long, text string"))


def test_hash_embedding_without_positive_components(spark, tmp_path):
    signs = lambda w: {s for _, s in semantic._places(f"w:{w}", 256, 3)}
    below = [w for w in (f"w{i}" for i in range(200)) if signs(w) == {-1.0}]
    texts = [*below, " ".join(below[:3]), "é ü", "tea boat", "ship"]
    assert len(below) > 5
    same_as_sql(spark, tmp_path, "hash_embedding", conversations=spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], CONVERSATIONS))


def test_products_are_bounded(spark, monkeypatch):
    """Whatever the sizes of a block and of its queries, no product has more than CELLS numbers, and the nearest stay the same."""
    random = np.random.default_rng(1)
    vectors, queries, sizes = random.normal(size=(500, 8)), random.normal(size=(90, 8)), []
    got = lambda: [(i, at.tolist(), far.tolist()) for i, at, far in ivf.nearest_of(vectors, queries, 5)]
    whole, plain = got(), np.partition
    monkeypatch.setattr(ivf, "CELLS", 2000)
    monkeypatch.setattr(np, "partition", lambda x, *a, **b: (sizes.append(x.size), plain(x, *a, **b))[1])
    again = got()
    assert [(i, at) for i, at, _ in again] == [(i, at) for i, at, _ in whole] and max(sizes) <= 2000


def test_queries_of_a_list_in_lots(spark, monkeypatch):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.select(F.col("vec_id").alias("query_id"), "embedding")
    centers = ivf.centroids(df, 3)
    index = ivf.Index(ivf.blocks(ivf.dealt(df, centers), "vec_id"), centers, "vec_id", "embedding")
    got = lambda: {(r.query_id, r.vec_id, r["rank"]) for r in ivf.search(index, asked, 5, 3).collect()}
    whole = got()
    monkeypatch.setattr(ivf, "ASKED", 50)
    plan = ivf.search(index, asked, 5, 3)._jdf.queryExecution().toString()
    assert got() == whole and len(whole) == 1500 and "lot" in plan


def test_texts_of_a_batch_are_strings_in_lots():
    """However many texts a batch has, few of them are Python's strings at a time."""
    texts = pa.array([f"{i} É" + "e" * 2000 for i in range(4000)])
    for udf, plain in ((X._normalized, X.normal), (X.mask_credentials, X.masked_text)):
        tracemalloc.start()
        found = udf.func(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 4_000_000 and found.to_pylist() == [plain(t) for t in texts.to_pylist()]
        assert udf.func(texts[:0]).to_pylist() == [] and udf.func(pa.array([None, ""])).to_pylist() == [None, ""]


def test_normal_form_of_plain_and_other_texts(spark, monkeypatch):
    """ASCII is lower-cased by Spark, only the rest is sent to Python, and both are as normal() has them."""
    texts = [None, "", "A\x00Z [\\]", "TEA", "Stra\u00dfe", "\ufb01SH", "\u0130I", "\u212a", "\U0001f600 A", "\u00c9", "e\u0301", "\x7fX\x80"] * 100
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = lambda: [r.s for r in df.select("i", X.normalize("text").alias("s")).sort("i").collect()]
    assert got() == [t if t is None else X.normal(t) for t in texts]
    monkeypatch.setattr(X, "_normalized", F.arrow_udf(lambda t: pa.array(["sent" if x.is_valid else None for x in t], pa.string()), "string"))
    assert got() == [t if t is None else t.lower() if t.isascii() else "sent" for t in texts]


def test_paths_in_lots(spark, monkeypatch):
    """Paths of more conversations than a lot has: a chain, a branch, a round and a missing parent."""
    monkeypatch.setattr(archive, "LOT", 3)
    kinds = [[("0", None), ("1", "0"), ("2", "1")], [("0", None), ("1", "0"), ("2", "0")], [("0", "2"), ("1", "0"), ("2", "1")], [("1", "0"), ("2", "1")]]
    want = [["0", "1", "2"], ["0", "2"], [], []]
    edges = spark.createDataFrame([(f"c{i}", *e) for i in range(40) for e in kinds[i % 4]], "conversation string, node string, parent string").coalesce(1)
    leaves = spark.createDataFrame([(f"c{i}", "2") for i in range(40)], "conversation string, node string").coalesce(1)
    found = {(r.conversation, r.depth, r.node) for r in archive.selected_path(edges, leaves).collect()}
    assert found == {(f"c{i}", d, n) for i in range(40) for d, n in enumerate(want[i % 4])}


def test_lists_of_the_driver_start_no_python(spark, tmp_path):
    """A table without rows and the starts of numbers come from the JVM, so that executors start no Python to pass them on."""
    lake = store.Lake(spark, str(tmp_path / "lake"))
    for name in store.SCHEMAS | store.DERIVED:
        df = lake.table(name)
        assert df.count() == 0 and df.schema.simpleString() == spark.createDataFrame([], (store.SCHEMAS | store.DERIVED)[name]).schema.simpleString()
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()
    staged = []
    rows = spark.range(50).select(F.timestamp_seconds("id").alias("created_at"), F.col("id").cast("string").alias("revision_id"))
    out, n = store.numbered(lake, rows, 7, staged)
    assert n == 50 and [r.doc for r in out.sort("created_at").collect()] == list(range(7, 57))
    assert "ExistingRDD" not in out._jdf.queryExecution().toString()
