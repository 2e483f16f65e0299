import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from chatlake.functions import text as X
from chatlake.operators import archive as A
from chatlake.plans import more, queries

QUERIES, SQL = queries.QUERIES | more.QUERIES, queries.SQL | more.SQL

D = "/root/testdata/sf0.01"


def rows(pdf):
    plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else int(v) if isinstance(v, (float, np.integer)) and v == int(v) else v
    return sorted(str(tuple(plain(v) for v in r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    got = rows(QUERIES[name](spark, D).toPandas())
    assert got == rows(c.sql(SQL[name]).df()) if name in SQL else got


def test_normal_form_and_spans():
    assert X.normal("ＴＥＡ绿茶 Straße") == "tea绿茶 strasse"
    text = "Straße AI"
    assert X.raw_span(text, 8, 10) == (7, 9)


def test_cjk_search(spark):
    texts = ["海边的灯塔很高", "灯塔灯塔，灯塔在夜里亮着", "Baking BREAD slowly", "买了ＢＲＥＡＤ和牛奶", "今天下雨"]
    df = spark.createDataFrame([(f"e{i}", t, None) for i, t in enumerate(texts)], "event_id string, text string, created_at timestamp").withColumn("search_text", X.normalize("text"))
    found = {r.event_id: r.score for r in A.search(df, "bread").collect()}
    assert found == {"e2": 1, "e3": 1}
    assert {r.event_id: r.score for r in A.search(df, "灯塔").collect()} == {"e0": 1, "e1": 3}
    assert A.search(df, "灯塔 bread").count() == 0
    with pytest.raises(ValueError, match="empty"):
        A.search(df, "")


def test_index_tokens_and_masking(spark):
    df = spark.createDataFrame([("买tea和绿茶叶 ok", 'x token = "0123456789abcdef" y')], "a string, b string")
    from pyspark.sql import functions as F

    r = df.select(X.index_tokens(F.col("a")).alias("t"), X.mask_credentials("b").alias("m"), F.col("b")).first()
    assert r.t == ["买", "tea", "和绿", "绿茶", "茶叶", "ok"]
    assert len(r.m) == len(r.b)
    assert "0123456789abcdef" not in r.m


def test_export_and_inbox(spark, tmp_path):
    import json

    from chatlake.sources.exports import chat_export
    from chatlake.streaming.inbox import follow, publish_new

    node = lambda i, parent, children, text: {"id": i, "parent": parent, "children": children, "message": text and {"id": f"m-{i}", "author": {"role": "user"}, "create_time": 1700000000.5, "content": {"content_type": "text", "parts": [text, ""]}}}
    export = [{"title": "t", "current_node": "c", "mapping": {"a": node("a", None, ["b", "c"], None), "b": node("b", "a", [], "x"), "c": node("c", "a", [], "y")}}]
    (tmp_path / "conversations.json").write_text(json.dumps(export))
    got = {r.node: r for r in chat_export(spark, str(tmp_path / "conversations.json"), "me").collect()}
    assert got["a"].event_id is None
    assert got["c"].event_id == "chatgpt:me:m-c"
    assert (got["b"].child_order, got["c"].child_order, got["c"].speaker, got["c"].text) == (0, 1, "owner", "y")
    assert got["a"].conversation.startswith("conv-fb-")
    box = tmp_path / "inbox"
    box.mkdir()
    for k in range(2):
        (box / f"{k}.json").write_text('{"id": 1, "v": "a"}\n{"id": 2, "v": "b"}\n')
        follow(spark, str(box), "id long, v string", str(tmp_path / "cp"), publish_new(str(tmp_path / "out"), ["id"])).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_selected_path_of_long_conversations(spark):
    edges = [(c, i, i - 1 if i else None) for c, n in (("a", 65), ("b", 66), ("c", 1500)) for i in range(n)]
    edges += [("branch", 0, None), ("branch", 1, 0), ("branch", 2, 0), ("cycle", 0, 1), ("cycle", 1, 0), ("dangling", 1, 7), ("own", 3, 3), ("noleaf", 0, None)]
    leaves = [("a", 64), ("b", 65), ("c", 1499), ("branch", 2), ("cycle", 1), ("dangling", 1), ("own", 3), ("noleaf", 5)]
    got = A.selected_path(spark.createDataFrame(edges, "conversation string, node long, parent long"), spark.createDataFrame(leaves, "conversation string, node long"))
    want = [(c, i, i) for c, n in (("a", 65), ("b", 66), ("c", 1500)) for i in range(n)] + [("branch", 0, 0), ("branch", 2, 1)]
    assert sorted((r.conversation, r.node, r.depth) for r in got.collect()) == sorted(want)


def test_export_keeps_text_that_looks_like_an_object(spark, tmp_path):
    import json

    from chatlake.sources.exports import chat_export

    parts = {"a": ['{"x": 1}'], "b": ["{code}", {"asset_pointer": "p"}, None, "", "é"], "c": [{"asset_pointer": "p"}]}
    mapping = {k: {"id": k, "parent": None, "children": [], "message": {"id": k, "author": {"role": "user"}, "content": {"content_type": "text", "parts": v}}} for k, v in parts.items()}
    (tmp_path / "e.json").write_text(json.dumps([{"id": "i", "mapping": mapping}]))
    assert {r.node: r.text for r in chat_export(spark, str(tmp_path / "e.json"), "me").collect()} == {"a": '{"x": 1}', "b": "{code}\né", "c": None}
