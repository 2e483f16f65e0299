"""Operators 11 to 13 against plain Python."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import collocations, filter_audit, language_id

DOC = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = " \t\n\x0b\x0c\r"


def words(t):
    out, w = [], ""
    for c in t or "":
        if c in BLANKS:
            out, w = out + [w] * bool(w), ""
        else:
            w += c
    return out + [w] * bool(w)


def frame(spark, rows):
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    return spark.createDataFrame(rows, DOC).withColumn("part", F.lit("clash")).withColumn("id", F.lit("clash")).withColumn("salt", F.lit(1)).withColumn("key", F.lit(2))


# --- operator 11


def audit_rows():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choices(vocab, k=r.choice([30, 90, 120, 400]))), r.choice(["en", "de", None])) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " # x", "en") for i in range(10)] + [(300 + i, rows[i][1].upper(), None) for i in range(15)]
    rows += [(400 + i, rows[3][1], "de") for i in range(30)] + [(400, rows[3][1], "de")] * 2 + [(0, rows[0][1], "en")]
    rows += [(None, rows[5][1], "en"), (None, rows[5][1], "fr"), (None, None, None), (500, None, "en"), (501, "", "en"), (502, "   \n", "en")]
    return rows + [(600, "long word " * 30000, "en"), (-7, rows[9][1], "fr"), (601, "ÄÖÜ Ab", "")]


AUDIT_LABELS = [(i, i % 2, i % 3 == 0) for i in range(0, 450, 2)] + [(1, 1, False), (1, 0, True), (None, 1, True), (3, None, None)]


def audited_by_hand(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    by = {}
    for i, t, lang in rows:
        t, w = t or "", words(t)
        fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        fails += "E" * (i is not None and i > least[t])
        by.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, docs in by.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[0]]
                gone = sum(f in d[0] for d in docs) - len(here)
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(here)
                only = sum(d[0] == f for d in docs)
                out[part, "".join(order), step] = [len(left), len(here), gone, only, sum(d[1] for d in here), sum(d[2] for d in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_filter_audit(spark):
    rows = audit_rows()
    labels = spark.createDataFrame([(i, q, None if x is None else int(x)) for i, q, x in AUDIT_LABELS], "doc_id long, quality int, toxic int").withColumn("mask", F.lit(0))
    got = filter_audit.audited(frame(spark, rows), labels).collect()
    want = audited_by_hand(rows, AUDIT_LABELS)
    assert len(got) == len(want) == 600 * len({lang or "" for _, _, lang in rows})
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got} == want


def test_filter_audit_sums_invert_exactly(spark):
    r = random.Random(1)
    rows = [("p", r.random() < 0.5, r.random() < 0.2, r.randrange(32)) for _ in range(500)]
    sums = filter_audit.parity_sums(spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int"))
    row = sums.select(*[filter_audit.inverted(F.col(k)) for k in ("every", "good", "toxic")]).first()
    assert list(row[0]) == [sum(x[3] == m for x in rows) for m in range(32)]
    assert list(row[1]) == [sum(x[3] == m and x[1] for x in rows) for m in range(32)]
    assert list(row[2]) == [sum(x[3] == m and x[2] for x in rows) for m in range(32)]


def test_filter_audit_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(frame(spark, []), labels).count() == 0
    part = filter_audit.audited(frame(spark, [(1, None, None)]), labels).collect()
    assert len(part) == 600 and {r["part"] for r in part} == {""} and {r["removed"] for r in part} == {0, 1}


# --- operator 12


def speech(r, lang, n):
    parts = {"aa": ["ka", "to", "mi", "ra", "sé", "lu"], "bb": ["schn", "er", "tz", "öl", "gru", "au"], "cc": ["th", "ing", "qu", "ea", "ly", "wh"]}[lang]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))).capitalize() for _ in range(n))


def spoken_rows():
    r = random.Random(8)
    rows = [(i, speech(r, lang, r.randint(3, 60)) + r.choice([".", "!", "", " 42"]), lang) for i, lang in enumerate(r.choices(["aa", "bb", "cc"], [6, 3, 1], k=300))]
    rows += [(1000 + i, speech(r, "bb", 20), None) for i in range(20)]  # not learned from, predicted all the same
    rows += [(2000, None, "aa"), (2001, "", "aa"), (2002, "12 -- 34!", "bb"), (None, speech(r, "aa", 30), "aa"), (5, rows[5][1], rows[5][2])]
    rows += [(2003, "\U00010400 \U0001F600 İstanbul ǅ", "aa"), (2004, speech(r, "cc", 120_000), "cc"), (2005, "*" * 600_000 + " " + speech(r, "aa", 9), None)]
    i = next(i for i in range(3000, 4000) if zlib.crc32(str(i).encode()) % 4 == 3)
    return rows + [(i, "ææ øø ææø " * 9, "dd")]  # a language whose only document has remainder 3


def symbols(t):
    out, before = [], False
    for c in t or "":
        letter = c.isalpha()
        if letter:
            low = c.lower()
            out.append(chr(0xFFFE) if ord(c) > 0xFFFF else low if len(low) == 1 else c)
        elif before:
            out.append(" ")
        before = letter
    return out


def kneser_ney(texts, order):
    """Probability of a symbol after order - 1 others, and the interpolated lower orders, from dictionaries."""
    counts = {order: collections.Counter()}
    for t in texts:
        s = [" "] * (order - 1) + symbols(t)
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    total, types, d = {}, {}, {}
    for k, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        for g, v in c.items():
            total[k, g[:-1]] = total.get((k, g[:-1]), 0) + v
            types[k, g[:-1]] = types.get((k, g[:-1]), 0) + 1

    def p(g):
        k = len(g)
        if k == 1:
            left = d[1] * types[1, ()] / total[1, ()] / (types[1, ()] + 1)
            return left + (max(counts[1][g] - d[1], 0) / total[1, ()] if g in counts[1] else 0)
        if (k, g[:-1]) not in total:
            return p(g[1:])
        seen = (counts[k][g] - d[k]) / total[k, g[:-1]] if g in counts[k] else 0
        return seen + d[k] * types[k, g[:-1]] / total[k, g[:-1]] * p(g[1:])

    return p


@pytest.fixture(scope="module")
def spoken(spark):
    rows = spoken_rows()
    got = language_id.identified(frame(spark, rows).withColumn("best", F.lit("clash"))).collect()
    return rows, got


def test_language_id_against_dictionaries(spoken):
    rows, got = spoken
    part = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 4
    learned = [(part(i), t, lang) for i, t, lang in rows if i is not None and t is not None and lang and part(i) != 2]
    langs = sorted({lang for _, _, lang in learned})
    counted = {lang: [t for p, t, x in learned if x == lang and p < 3] or [t for _, t, x in learned if x == lang] for lang in langs}
    models = {lang: kneser_ney(t, language_id.ORDER) for lang, t in counted.items()}
    assert len(got) == len(rows) and sorted(models) == ["aa", "bb", "cc", "dd"]
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    memo = {}
    for i, t, _ in rows:
        s = symbols(t)
        for r in by[i]:
            assert r["held_out"] == (part(i) == 2) and r["n_symbols"] == len(s)
            if not s:
                assert (r["lang_pred"], r["score"], r["accepted"], r["entropy"]) == ("und", 0.0, False, None)
                continue
            grams = collections.Counter(zip(*[([" "] * 3 + s)[k : len(s) + k] for k in range(4)], strict=True))
            cost = {}
            for lang, p in models.items():
                for g in grams:
                    if (lang, g) not in memo:
                        memo[lang, g] = -math.log(p(g))
                cost[lang] = sum(n * memo[lang, g] for g, n in grams.items()) / len(s)
            want = min(cost, key=lambda x: (cost[x], x))
            assert r["lang_pred"] == want and r["entropy"] == pytest.approx(cost[want], rel=0.01)
            assert r["score"] == pytest.approx(1 / sum(math.exp(20 * (cost[want] - c)) for c in cost.values()), abs=0.02)
            assert r["accepted"] == (r["entropy"] <= r["entropy_limit"])


def test_language_id_lots_and_pieces(spark, spoken, monkeypatch):
    """A lot for each language gives the same rows as one for all."""
    rows, got = spoken
    monkeypatch.setattr(language_id, "MODEL_BYTES", 1)
    again = language_id.identified(frame(spark, rows)).collect()
    key = lambda r: (str(r["doc_id"]), r["lang_pred"], r["accepted"], r["n_symbols"], round(r["score"], 4))
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_language_id_pieces_count_alike():
    import pyarrow as pa

    text = "Ab, ç " * 90_000 + "\U0001F600 zz"
    parts = [code for _, _, code, _ in language_id.coded(pa.array([text]), 4)]
    whole, _, _ = language_id.grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), 4)
    assert len(parts) > 2 and (np.concatenate(parts) == whole).all()


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.op12_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert len(rows) > 200 and right >= 0.97 * len(rows)
    assert sum(r["accepted"] for r in rows) >= 0.9 * len(rows)


def test_language_id_nothing_learned(spark):
    assert language_id.identified(frame(spark, [])).count() == 0
    rows = language_id.identified(frame(spark, [(1, "abc", None), (None, "abc", "en")])).collect()
    assert [(r["lang_pred"], r["score"], r["held_out"]) for r in rows] == [("und", 0.0, False)] * 2


# --- operator 13


def mined_rows():
    r = random.Random(6)
    vocab = ["the", "of", "New", "york", "straße", "a", "b", "hot", "dog", "it's"] + [f"w{i}" for i in range(40)]
    marks = [" ", " ", " ", "  ", ", ", ". ", "\t", "\n", ";", "!"]
    text = lambda n: "".join(r.choice(vocab) + r.choice(marks) for _ in range(n))
    rows = [(i, text(r.randint(1, 200)) + r.choice(["", "new york city. ", "a a a a", "Hot dog hot dog"]), r.choice(["en", "en", "de", None, "und"])) for i in range(250)]
    rows += [(400, "x y z " * 60_000, "en"), (401, "long piece, " * 40_000, "de"), (None, "hot dog " * 11, "fr"), (402, None, "es"), (403, "", None), (404, "...", "es")]
    return rows + rows[:3] + [(500 + i, f"q{i} z{i} " * 12, "tie") for i in range(80)]


def collocated_by_hand(rows, top):
    f = collections.defaultdict(collections.Counter)
    for _, t, lang in rows:
        piece = []
        for c in (t or "") + ".":
            if c in ".,;:!?\n\x0b\x0c\r":
                own = "".join(piece).replace("\t", " ").split(" ")
                own, piece = [w for w in own if w], []
                for k in (1, 2, 3):
                    f[lang or "und"].update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
            else:
                piece.append(chr(ord(c) + 32) if "A" <= c <= "Z" else c)
    out = []
    for lang, own in f.items():
        n, found = sum(v for g, v in own.items() if len(g) == 1), []
        for g, a in own.items():
            if len(g) < 2 or a < 10:
                continue
            score, k = min((1_000_000 * a * a // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]], g))
        longer = collections.Counter()
        for x in found:
            for i in (0, 1):
                if len(x[5]) == 3:
                    longer[x[5][i : i + 2]] = max(longer[x[5][i : i + 2]], -x[1])
        found = sorted(x for x in found if len(x[5]) == 3 or not longer[x[5]] or 100 * longer[x[5]] < 50 * -x[1])
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for i, x in enumerate(found[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("small", "top"), [(False, 2000), (True, 7)])
def test_collocations(spark, monkeypatch, small, top):
    """small: many shards, each asked by several groups, whose arrays are summed in a deep tree."""
    rows = mined_rows()
    if small:
        for name, value in (("SHARD", 64), ("ASKED", 8), ("FAN", 2)):
            monkeypatch.setattr(collocations, name, value)
    docs = frame(spark, rows).repartition(6)
    got = sorted(tuple(r) for r in collocations.mine(docs, top=top).collect())
    want = collocated_by_hand(rows, top)
    assert len(want) > (20 if small else 150) and {x[0] for x in want} == {"en", "de", "und", "fr", "tie"}
    assert got == want


def test_collocations_scores_pass_64_bits(spark):
    a, b = 3 * 10**12, 9 * 10**12
    expr = "(1000000BD * (cast(a as decimal(16,0)) * cast(a as decimal(16,0)))) div (cast(a as decimal(19,0)) * cast(b as decimal(19,0)))"
    assert spark.createDataFrame([(a, b)], "a long, b long").selectExpr(expr).first()[0] == 1_000_000 * a * a // (a * b)


def test_collocations_empty(spark):
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [(1, "once only", "en")])).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    slots = collocations.Slots.build(keys)
    assert sorted(slots(keys).tolist()) == list(range(len(keys)))  # minimal and perfect
    assert (slots.keys[slots(keys)] == keys).all()
    assert (slots(keys + np.uint64(1 << 63)) == -1).all()  # stored keys tell others apart
    assert len(collocations.Slots.build(np.zeros(0, np.uint64))(keys)) == len(keys)
