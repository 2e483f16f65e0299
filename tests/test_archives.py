"""Archives read element by element, and what leads where along a relation."""

import io
import json
import os
import random
import tracemalloc
import zipfile

import pytest

from chatlake.operators import closure, facts
from chatlake.sources import archives, exports
from chatlake.sources.exports import ArchiveRejected


def cut(data, size):
    """A stream that gives at most size bytes at a time."""

    class Stream(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, size))

    return Stream(data)


def some(r, depth=0):
    kind = r.randrange(7 if depth < 4 else 4)
    if kind == 0:
        return r.choice([None, True, 12.5, -3])
    if kind < 4:
        return "".join(r.choices(['"', "\\", "{", "]", ",", "é", "x", " ", "\n", "conversations"], k=r.randrange(12)))
    if kind == 4:
        return [some(r, depth + 1) for _ in range(r.randrange(4))]
    return {f"k{i}\"": some(r, depth + 1) for i in range(r.randrange(4))}


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
def test_elements_of_any_json(size):
    r = random.Random(size)
    for i in range(60):
        rows = [some(r) for _ in range(r.randrange(6))]
        for text in (json.dumps(rows), json.dumps(rows, ensure_ascii=False, indent=1), "﻿" + json.dumps(rows)):
            assert [json.loads(x) for x in archives.elements(cut(text.encode(), size))] == rows
        whole = {"other": [1, {"conversations": [2]}], "conversations": rows, "more": [[3], "conversations"]}
        assert [json.loads(x) for x in archives.elements(cut(json.dumps(whole).encode(), size))] == rows
    assert list(archives.elements(cut(b'{"a": [1, 2]}', size))) == list(archives.elements(cut(b"", size))) == []
    with pytest.raises(ArchiveRejected):
        list(archives.elements(cut(b'[{"a": 1}, {"b', size)))


class Endless:
    """An array of many conversations that is made while it is read."""

    def __init__(self, elements, size):
        self.left, self.one, self.held = elements, b'{"mapping": {"n": "' + b"x" * size + b'"}}', b"["

    def read(self, n):
        while len(self.held) < n and self.left:
            self.left -= 1
            self.held += self.one + (b"," if self.left else b"]")
        out, self.held = self.held[:n], self.held[n:]
        return out


def test_memory_is_bounded():
    tracemalloc.start()
    try:
        n = sum(1 for _ in archives.elements(Endless(4000, 50_000)))  # 200 MB
        assert n == 4000 and tracemalloc.get_traced_memory()[1] < 12 << 20
    finally:
        tracemalloc.stop()


def talk(i, n=3):
    nodes = {f"n{j}": {"id": f"n{j}", "parent": f"n{j - 1}" if j else None, "message": {"id": f"m{i}-{j}" if j != 1 else None, "author": {"role": "user"}, "content": {"parts": [f"text {i} {j}"]}}} for j in range(n)}
    return {"conversation_id": f"c{i}", "title": "t", "current_node": f"n{n - 1}", "mapping": nodes}


def test_source(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.json").write_text(json.dumps([talk(1), talk(2)]))
    (tmp_path / "in" / "deep" / "b.json").write_text(json.dumps({"conversations": [talk(3)]}))
    (tmp_path / "in" / "note.txt").write_text("[1]")
    with zipfile.ZipFile(tmp_path / "in" / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/conversations.json", json.dumps([talk(4), talk(5)]))
        z.writestr("empty.json", "[]")
    rows = archives.archive_elements(spark, str(tmp_path / "in"))
    assert rows.rdd.getNumPartitions() == 4  # a partition a member
    got = [(os.path.basename(r.file), r.place, json.loads(r.value)["conversation_id"]) for r in rows.collect()]
    assert sorted(got) == [("a.json", 0, "c1"), ("a.json", 1, "c2"), ("b.json", 0, "c3"), ("conversations.json", 0, "c4"), ("conversations.json", 1, "c5")]
    nodes = exports.chat_export(spark, "", "me", rows.select("file", "value")).collect()
    assert len(nodes) == 15 and {n.conversation for n in nodes} == {f"c{i}" for i in range(1, 6)}
    assert {n.message_id for n in nodes if n.node == "n1"} == {None}
    assert archives.archive_elements(spark, str(tmp_path / "in" / "note.txt")).count() == 0


def test_source_refuses(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out.json").write_text("[1]")
    os.symlink(tmp_path / "out.json", tmp_path / "in" / "link.json")
    with pytest.raises(ArchiveRejected, match="leads out"):
        archives.members(str(tmp_path / "in"))
    os.remove(tmp_path / "in" / "link.json")
    (tmp_path / "in" / "a.json").write_text("[1]")
    os.symlink(tmp_path / "in" / "a.json", tmp_path / "in" / "b.json")  # stays inside
    assert len(archives.members(str(tmp_path / "in"))) == 2
    for limits in ({"members": 1}, {"total_bytes": 5}):
        with pytest.raises(ArchiveRejected, match="too many"):
            archives.members(str(tmp_path / "in"), limits)
    with zipfile.ZipFile(tmp_path / "bad.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("../up.json", "[]")
    with pytest.raises(ArchiveRejected, match="unsafe"):
        archives.members(str(tmp_path / "bad.zip"))
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.json", "[" + " " * 3_000_000 + "]")
    with pytest.raises(ArchiveRejected, match="too large"):
        archives.members(str(tmp_path / "bomb.zip"))
    with pytest.raises(Exception, match="unsafe"):
        archives.archive_elements(spark, str(tmp_path / "bad.zip")).count()


def closed(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in edges if b == c} - out:
        out |= more
    return out


def test_closure(spark):
    r = random.Random(9)
    edges = {(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(45)} | {("a", "b"), ("b", "c"), ("c", "a"), ("s", "s")}
    frame = lambda rows, names: spark.createDataFrame(sorted(rows), f"{names[0]} string, {names[1]} string")
    df = frame(edges, ("source", "target"))
    starts = sorted({a for a, _ in edges})
    got = closure.reached(df, spark.createDataFrame([(s,) for s in starts], "start string"))
    assert sorted(tuple(x) for x in got.select("start", "node").collect()) == sorted(closed(edges))
    proposed = {("d", "a"), ("c", "d"), ("n0", "z"), ("q", "q"), ("a", "d2"), ("x1", "x2"), ("x2", "x1")}
    both = closed(edges | proposed)
    bad = closure.on_circles(df, frame(proposed, ("source", "target")))
    assert {tuple(x) for x in bad.collect()} == {(a, b) for a, b in proposed if (b, a) in both or a == b}
    assert closure.reached(df.filter("false"), spark.createDataFrame([("a",)], "start string")).count() == 0


def test_a_batch_of_decisions(spark):
    relations = spark.createDataFrame([("b", "a", "supersedes", "confirmed"), ("c", "b", "supersedes", "dismissed")], "new_id string, old_id string, relation string, status string")
    decisions = spark.createDataFrame([("a", "b", "supersedes"), ("d", "b", "supersedes"), ("x", "y", "supersedes"), ("y", "x", "supersedes"), ("e", "a", "dismiss"), ("e", "b", "coexists"), ("e", "c", "no such")], "new_id string, old_id string, decision string")
    rows, bad = facts.decide_all(relations, decisions)
    assert {tuple(r) for r in rows.collect()} == {("d", "b", "supersedes", "confirmed"), ("e", "a", "dismiss", "dismissed"), ("e", "b", "coexists", "confirmed")}
    assert {(r.new_id, r.old_id) for r in bad.collect()} == {("a", "b"), ("x", "y"), ("y", "x")}
    assert facts.leads_to(relations, "b", "a") and not facts.leads_to(relations, "c", "a") and not facts.leads_to(relations, "a", "b")
