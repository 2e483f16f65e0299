import collections
import hashlib
import os
import random
import re
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import chat_format, components, decontaminate, line_dedup, mixing, ngram_join, pii, quality_lm, quality_rules, url_filter, warc_audit
from llm.common import Scratch, chunks
from llm.queries import QUERIES, SQL
from llm.wordhash import differing, parities

D = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(n=60, seed=1):
    r = random.Random(seed)
    vocab = ["the", "of", "and", "zebra", "straße", "naïve", "k9", "Lamp", "river", "stone", "cloud", "paper"] + [f"w{i}" for i in range(200)]
    texts = ["\n".join(" ".join(r.choices(vocab, k=r.randint(6, 30))) for _ in range(r.randint(1, 6))) for _ in range(n)]
    for i in range(0, n, 5):
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], texts[4].upper(), "", None, "   \n ", "one two", "one two", "x" * 70_000, "long word " * 4000]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], "s", len(t or "")) for i, t in corpus()]
    return spark.createDataFrame(rows, DOC).withColumn("component", F.lit("clash")).withColumn("id", F.lit("clash"))


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    got, want = QUERIES[name](spark, D).toPandas(), c.sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda df: sorted(map(str, df[cols].astype(str).itertuples(index=False, name=None)))
    assert key(got) == key(want)


@pytest.mark.parametrize(("k", "num", "held"), [(4, 85, None), (5, 80, 0)])
def test_ngram_join(docs, k, num, held):
    """held 0: components are joined up by distributed stars."""
    sets = {}
    for i, t in corpus():
        w = words(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = union_find(pairs, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, k, num, 100, held=held).collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}


def test_one_of_each_goes_by_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30 ", "x ")
    rows = [(5, base), (3, near), (None, base), (3, "other words " * 9), (7, ""), (7, ""), (3, near), (None, "alone " + base[::-1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, id int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in ngram_join.one_of_each(df).collect())
    assert got == sorted([(False, 3, near), (False, 3, "other words " * 9), (False, 7, ""), (False, 7, ""), (True, 0, "alone " + base[::-1])])


def test_parities_bound_the_symmetric_difference():
    r = random.Random(2)
    sets = [sorted({r.getrandbits(64) for _ in range(n)}) for n in (0, 1, 40, 300, 2000)]
    sets += [sorted(set(sets[3][:280]) | {r.getrandbits(64) for _ in range(9)}), sets[4][:1900]]
    size = np.array([len(x) for x in sets])
    cols, wide = parities(np.repeat(np.arange(len(sets)), size), np.concatenate([np.array(x, np.uint64) for x in sets]), size, 8)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            apart = len(set(x) ^ set(y))
            assert differing(wide[i], wide[j]) <= apart
            assert sum(int(c[i] ^ c[j]).bit_count() if c[i] >= 0 and c[j] >= 0 else bin(int(np.uint64(c[i].view(np.uint64) ^ c[j].view(np.uint64)))).count("1") for c in cols) <= apart
    assert differing(wide[3], wide[5]) > 20


def test_components_in_one_task_and_by_stars(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(r.randint(-300, 300), r.randint(-300, 300)) for _ in range(150)] + [(7, 7), (500, 501), (501, 500)]
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    want = {n: c for n, c in union_find(pairs, nodes | {7}).items() if n != c}
    edges = spark.createDataFrame(pairs, "a long, b long")
    for held in (0, 1_000):
        assert {x.node: x.component for x in components.components(edges, Scratch(spark, "test-cc"), held=held).collect()} == want
    assert components.components(edges.limit(0), Scratch(spark, "test-cc")).count() == 0


def brute_lines(rows):
    """Numbers of the lines to drop, by document, and the pairs of similar normal forms."""
    norm = lambda s: " ".join(words(lower(s)))
    seen = [(i, n, norm(x)) for i, t in rows for n, x in enumerate((t or "").split("\n")) if norm(x)]
    sets = {s: {s[j : j + 8] for j in range(len(s) - 7)} or {s} for _, _, s in seen}
    keys = list(sets)
    pairs = [(a, b) for x, a in enumerate(keys) for b in keys[:x] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root, first, want = union_find(pairs, keys), {}, collections.defaultdict(list)
    for i, n, s in seen:
        first.setdefault(root[s], (i, n))
    for i, n, s in seen:
        if first[root[s]] != (i, n):
            want[i].append(n)
    return want, pairs


@pytest.mark.parametrize("held", [None, 0])
def test_line_dedup(docs, held):
    want, _ = brute_lines(corpus())
    got = {r.doc_id: r.dropped for r in line_dedup.duplicate_lines(docs, held=held).collect()}
    assert got == {i: want[i] for i, _ in corpus()}


def test_without_duplicate_lines(spark, docs):
    want, _ = brute_lines(corpus())
    clash = docs.withColumns({"dropped": F.lit(1), "dup_id": F.lit(2), "key": F.lit(3), "row": F.lit(4)})
    more = spark.createDataFrame([(None, corpus()[0][1], "en", "s", 1), (None, "a line of its own here", "en", "s", 1), (0, "another text of document 0", "en", "s", 1), (70_000, "twice the same row", "en", "s", 1), (70_000, "twice the same row", "en", "s", 1)], DOC)
    every = clash.unionByName(more, allowMissingColumns=True)
    kept = collections.defaultdict(list)
    for r in line_dedup.without_duplicate_lines(every).collect():
        kept[r.doc_id].append(r.text)
    for i, t in corpus():
        left = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in want[i])
        gone = want[i] and not words(left)
        assert gone or (left if want[i] else t) in kept[i]
    assert "another text of document 0" in kept[0]
    assert kept[None] == ["a line of its own here"]
    assert kept[70_000] == ["twice the same row"]


def test_recall_of_bands_by_length():
    """The share of similar lines that share a band, counted by brute force, for short and long lines."""
    r = random.Random(8)
    letters = "abcdefghijklmnop "
    for low, high in ((12, 20), (20, 40), (40, 120), (120, 600)):
        pairs = []
        while len(pairs) < 400:
            a = "".join(r.choices(letters, k=r.randint(low, high)))
            b = a[: r.randint(int(0.75 * len(a)), len(a))] + "".join(r.choices(letters, k=r.randint(0, len(a) // 8)))
            norm = [" ".join(x.split()) for x in (a, b)]
            x, y = ({s[j : j + 8] for j in range(len(s) - 7)} for s in norm)
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and norm[0] != norm[1] and 100 * len(x & y) < 90 * len(x | y):
                pairs.append(norm)
        lines = line_dedup.Lines(*next(chunks(pa.array([s for p in pairs for s in p]), 1 << 30))[2:])
        tokens = line_dedup.band_tokens(line_dedup.signatures(lines, np.arange(len(lines.size))))
        assert (tokens[::2] == tokens[1::2]).any(1).mean() >= 0.95


def test_memory_of_many_short_lines_is_bounded():
    column = pa.array(["\n".join("".join(random.Random(i * 99 + j).choices("abcdefgh", k=25)) for j in range(800)) for i in range(100)])
    tracemalloc.start()
    for _, _, buf, off in chunks(column):
        lines = line_dedup.Lines(buf, off)
        which = np.arange(len(lines.size))
        line_dedup.band_tokens(line_dedup.signatures(lines, which))
        value, many = lines.sets(which)
        parities(np.repeat(which, many), value, many, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20


def test_line_dedup_of_short_lines(spark, tmp_path):
    long = "a line of more than twenty characters"
    texts = ["Les.\n" + long, "les.", "own\n \n les. ", "", "  ", "あの人は昨日来た。\nx", "あの人は昨日来た。", "--------\nlast words here 12", "----------\nlast words here 1", long + "\nLes.", "abcdefghi\nabcdefghj"]
    rows = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.dropped for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: "", 1: "0", 2: "2", 3: "", 4: "", 5: "", 6: "0", 7: "", 8: "0,1", 9: "0,1", 10: ""}
    kept = {r.doc_id: r.text for r in line_dedup.without_duplicate_lines(rows).collect()}
    assert kept == {0: texts[0], 2: "own\n ", 3: "", 4: "  ", 5: texts[5], 7: texts[7], 10: texts[10]}


def test_decontamination_in_several_passes(spark):
    items = [(1, "alpha beta gamma"), (2, " ".join(f"t{i}" for i in range(20))), (3, None), (4, "!!!")]
    texts = [(1, "x Alpha, BETA-gamma y"), (2, "z " * 5 + " ".join(f"t{i}" for i in range(3, 18))), (3, None), (4, "alphabeta gamma"), (5, "alpha beta gamma " + "q " * 100), (5, "")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1, 1 << 20):
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, bench, pattern_bytes=limit).collect())
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got == [(1, 5, 3, 1, sha("1"), True), (2, 20, 15, 1, sha("2"), True), (3, 0, 0, 0, sha(""), False), (4, 2, 0, 0, sha(""), False), (5, 0, 0, 0, sha(""), False), (5, 103, 3, 1, sha("1"), False)]
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    none = spark.createDataFrame([(None, "alpha beta gamma")], "item_id long, text string")
    hit = decontaminate.contamination(docs, none).filter("doc_id = 1").first()
    assert (hit.n_hit, hit.n_items, hit.items_sha256) == (3, 0, hashlib.sha256(b"").hexdigest())
    rows = spark.createDataFrame([(None, "alpha beta gamma", "a"), (1, "alpha beta gamma", "b"), (1, "clean words", "c"), (None, None, "d")], "doc_id long, text string, key string")
    assert sorted(r.key for r in decontaminate.decontaminate(rows, bench).collect()) == ["c", "d"]


def test_pii_base_against_plain_patterns():
    r = random.Random(5)
    parts = ["a.b@c.d", "x@y", "@", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123456-78", "+1", "é", " ", "007", ".", "-", "ab_%", "1.2.3.4.5.6.7.8"]
    digits = lambda s: re.sub(r"\D", "", s)
    for _ in range(500):
        t = "".join(r.choices(parts, k=12))
        want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
        assert pii.base_spans(t) == want
    assert [k for k, *_ in pii.find("iban DE89 3704 0044 0532 0130 00 X, tel 030 1234567")] == ["iban", "local_phone"]
    assert pii.find("order 030 1234567") == []
    assert pii.mask("to a@b.cd!") == "to [email]!"
    began = time.process_time()
    pii.find("1" * 300_000 + "a" * 300_000 + "." * 1000)
    pii.find("tel 030 1234567, +49 30 1234567, 1.2.3.4 a@b.cd " * 4000)
    assert time.process_time() - began < 8


def brute_pii(text):
    """All spans with the two kinds that the method adds, by plain loops."""
    out = [(*s, pii.score(text, *s)) for s in pii.base_spans(text)]
    apart = lambda a, b, kinds: all(b <= x or y <= a for k, x, y, _ in out if k in kinds)
    ibans = [("iban", a, b, s) for a, b in pii._ibans(text) if apart(a, b, pii.BASE) and (s := pii.score(text, "iban", a, b)) >= pii.ACCEPT]
    out += ibans
    out += [("local_phone", m.start(), m.end(), s) for m in pii._LOCAL_PHONE.finditer(text) if (s := pii.score(text, "local_phone", m.start(), m.end())) >= pii.ACCEPT and apart(m.start(), m.end(), (*pii.BASE, "iban"))]
    return sorted(out, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_pii_query_strings(spark, tmp_path):
    r = random.Random(6)
    parts = ["a.b@c.de ", "IBAN DE89 3704 0044 0532 0130 00 ", "tel 030 1234567 ", "order 030 7654321 ", "4111 1111 1111 1111 ", "10.0.0.1 ", "+49 30 123456789 ", "words é ", "0301234567 phone "]
    texts = ["".join(r.choices(parts, k=9)) for _ in range(60)] + ["", None]
    spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)
    got = pii.op6_pii(spark, str(tmp_path)).collect()
    for row in got:
        want = brute_pii(texts[row.doc_id or 0] or "")
        base = [s for s in want if s[0] in pii.BASE]
        assert (row.spans, row.base_sha256) == (joined(want), hashlib.sha256(joined(base).encode()).hexdigest())
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in pii.BASE]
    assert len(got) == len(texts) + 1
    assert sum("iban" in x.spans for x in got) > 10


def test_quality_rules_base(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    for i, t in corpus():
        w, t = words(t), t or ""
        spans = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = {x for j in range(len(w) - 7) if spans[tuple(w[j : j + 8])] > 1 for x in range(j, j + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += line in seen
            if words(line):
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def test_jensen_shannon():
    p, q = np.array([[1.0, 0], [1, 1], [0, 0]]), np.array([[0.0, 1], [2, 2], [1, 0]])
    assert quality_rules.distances(p, q).tolist() == [1.0, 0.0, 0.0]


def brute_distance(p, q):
    n, m = sum(p.values()), sum(q.values())
    if not n or not m:
        return 0.0
    part = lambda a, b, x, y: sum(v / x * np.log2((v / x) / ((a[k] / x + b[k] / y) / 2)) for k, v in a.items() if v)
    return np.sqrt(max(0, (part(p, q, n, m) + part(q, p, m, n)) / 2))


def test_quality_rules_kept(spark, docs):
    """Common words, histograms, limits and verdicts by plain dictionaries."""
    good = set(range(40))
    got = {r.doc_id: r for r in quality_rules.judge(docs, spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")).collect()}
    lang = {i: ("en", "de", "")[i % 3] for i, _ in corpus()}
    bare = lambda t: [b for w in words(t) if (b := re.sub(r"[.,;:!?'\"()]", "", lower(w)))]
    kind = lambda c: "b" if c in "\t\n\v\f\r " else "x" if ord(c) > 127 else "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" if c in ".,;:!?'\"()-" else "m"
    texts = {i: t or "" for i, t in corpus()}
    common = {}
    for x in ("en", "de", ""):
        count = collections.Counter(w for i in good if lang[i] == x for w in bare(texts[i]))
        top = sorted(count.values(), reverse=True)
        common[x] = set(count) if len(count) <= quality_rules.COMMON else {w for w, n in count.items() if n > top[quality_rules.COMMON]}
    if any(len(c) < quality_rules.COMMON for c in common.values()):  # ties at the edge go by hash: only counts above it are sure
        common = {x: None for x in common}
    classes = {i: collections.Counter(map(kind, t)) for i, t in texts.items()}
    ref = {x: sum((classes[i] for i in good if lang[i] == x), collections.Counter()) for x in ("en", "de", "")}
    chars = lambda i: sum(map(len, words(texts[i])))
    far = {i: brute_distance(classes[i], ref[lang[i]]) for i in texts if chars(i) >= quality_rules.MIN_CHARS}
    for i, v in far.items():
        assert got[i].class_distance == pytest.approx(v, abs=2e-6)
    for i in texts:
        assert (got[i].class_distance is None) == (i not in far)
        assert (got[i].word_distance is None) == (len(words(texts[i])) < quality_rules.MIN_WORDS)
    limits = {}
    for x in ("en", "de", ""):
        for name in ("class_distance", "word_distance"):
            v = sorted(d for i in good if lang[i] == x and (d := got[i][name]) is not None)
            limits[x, name] = (np.floor(v[int(np.ceil(quality_rules.QUANTILE * len(v))) - 1] * quality_rules.BINS + 1e-9) + 1) / quality_rules.BINS + quality_rules.SLACK if v else np.inf
    for i in texts:
        strange = any(got[i][name] is not None and got[i][name] > limits[lang[i], name] for name in ("class_distance", "word_distance"))
        assert got[i].kept == (not got[i].base_failed and not strange)


def test_url_filter(spark):
    urls = ["HTTP://A.Example.ORG/es/1?x", "http://example.org/en/12", "http://example.org/en/2", "http://org", "x", None, "http://cheap-casino.example.net/en/1", "http://therstone.example.net/en/1", "https://b.com/fr/1#t", "http://xcom/fr/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1][2:] == ("example.org/en/1", "block")
    assert got[2][2:] == ("org/", "allow")
    assert got[3][:3] == ("org", "", None)
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == (None, "block")
    assert got[7][2:] == (None, "allow")
    assert got[8][2:] == ("com/fr/", "allow")
    assert got[9][2] is None


ELSEWHERE = """
0 https://www.valley-hospital.invalid/departments/cardiology
0 http://readers.bookclub.test/reviews/latest
0 https://docs.queueing.invalid/manual/install.html
0 https://www.grundschule-am-see.test/termine
0 https://en.openatlas.test/wiki/River_delta
0 https://blog.coldwater.invalid/2020/11/swimming
0 https://theatre.oldtown.test/season
0 https://physics.hillside.invalid/lectures/optics
0 https://recettes-du-jardin.test/soupe
0 https://forum.beekeepers.invalid/thread/swarm
1 http://online-casino-wins.invalid/bonus
1 https://cheap-viagra.test/order
1 http://pokerstrip.invalid/free-bets
1 https://xxx-adult.test/videos
1 http://fast-loans.invalid/apply-now
1 https://replica-rolex.test/cheap
1 http://prize-winner.invalid/claim
1 https://spam-backlinks.test/seo
1 http://slots-jackpot.invalid/spin
1 https://ads-click.test/track
"""


def test_url_model_on_urls_from_elsewhere_and_against_plain_sums(spark):
    held = [(int(x[0]), x[2:]) for x in ELSEWHERE.strip().split("\n")]
    rows = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(held)], "page_id long, url string")
    table = spark.createDataFrame(url_filter.labelled_urls(), "url string, label int")
    got = {r.page_id: r for r in url_filter.judge(rows, rules=[], labelled=table).collect()}
    assert sum((got[i].verdict == "block") == bool(y) for i, (y, _) in enumerate(held)) >= 18
    weights, bias = url_filter.train(url_filter.labelled_urls())
    mixed = lambda h: int(url_filter.mix(np.array([h], np.uint64))[0])
    for i, (_, u) in enumerate(held):
        host, path = url_filter.split_url(u)
        z = bias
        for seed, s in enumerate((url_filter.site(host), path)):
            raw, own = f"^{s}$".encode(), []
            for k in url_filter.SIZES:
                for j in range(len(raw) - k + 1):
                    value = 0
                    for c in raw[j : j + k]:
                        value = (value * 257 + c) % 2**64
                    own.append(weights[mixed((value * 16 + k * 2 + seed) % 2**64) >> 48])
            z += sum(own) / np.sqrt(max(1, len(own)))
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
    with pytest.raises(ValueError, match="at most"):
        url_filter.train([("http://x.test/", 0)] * (url_filter.MAX_LABELLED + 1))


def test_chat_formatting_edges(spark):
    rows = [(0, "user", "q", 0), (1, "assistant", "good", 0), (0, "user", "q", 1), (1, "assistant", "bad", 1)]
    df = spark.createDataFrame([(7, s, s, t, r, x) for t, r, x, s in rows] + [(8, 0, 2, 0, None, None), (9, 0, 3, 0, "user", "a"), (9, 1, 4, 0, "user", "a")], "pair_id long, side int, conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat_format.preference_pairs(df).collect()}
    assert got[7].prompt == "<|user|>\nq<|end|>\n"
    assert got[7].chosen == "<|assistant|>\ngood<|end|>\n"
    a, b = map(int, got[7].chosen_mask.split(":"))
    assert got[7].chosen[a:b] == "good<|end|>"
    assert (got[8].status, got[8].rejected, got[9].status, got[9].chosen) == ("unpaired", None, "identical", "")


def test_pairs_of_conversations_share_their_prompt(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "x"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (None, 0, "user", "n"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("side", F.lit("clash")).withColumn("pair_id", F.lit("clash"))
    got = {r.pair_id: r for r in chat_format.preference_pairs(chat_format.swapped(df)).collect()}
    assert (got[1].n_prompt, got[1].chosen, got[1].rejected) == (1, "<|assistant|>\na<|end|>\n", "<|assistant|>\nb<|end|>\n")
    assert (got[2].n_prompt, got[2].rejected, got[2].status) == (1, "", "pair")
    assert (got[5].rejected_id, got[5].status) == (None, "unpaired")
    assert set(got) == {1, 2, 5}


def test_warc_audit_of_equal_and_empty(spark):
    df = spark.createDataFrame([(1, 70_000 * i, 9, f"d{i}") for i in range(50)], "file long, offset long, length long, digest string")
    assert warc_audit.audit(df, df).count() == 0
    assert warc_audit.audit(df.limit(0), df.limit(0)).count() == 0
    bad = df.withColumn("digest", F.when(F.col("offset") == 70_000 * 17, "x").otherwise(F.col("digest"))).filter(F.col("offset") != 0)
    got = sorted((r.offset, r.status) for r in warc_audit.audit(df, bad).collect())
    assert got == [(0, "missing"), (70_000 * 17, "corrupt")]


def test_warc_drill_of_repeated_and_null_pages(spark):
    rows = [(13, "u", "a"), (13, "u", "b"), (13, None, "a"), (7, "u", None), (8, "u", "x"), (None, "u", "y"), (None, "u", "z")]
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], "page_id long, url string, html string, file int, digest string")
    got = warc_audit.drill(df).collect()
    assert sorted(r.status for r in got) == ["corrupt"] * 3 + ["missing"]
    assert all(r.found is None or r.found != r.expected for r in got)


def test_mixing(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 7 == 0)) for i in range(50)], "doc_id long, quality int, toxic int")
    got = mixing.rates(docs, labels).toPandas()
    assert len(got) == docs.count()
    assert (got.rate >= 0).all()
    assert (mixing.rates(docs, labels.limit(0)).toPandas().rate >= 0).all()
    assert mixing.rates(docs.limit(0), labels).count() == 0


def test_mixing_meets_targets(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op4_mixing"](spark, d).toPandas()
    assert got.gap.max() < mixing.TOLERANCE
    for domain, share in mixing.TARGETS.items():
        assert (got.rate * got.n_tokens * got[f"p_{domain}"]).sum() / got.n_tokens.sum() == pytest.approx(share, abs=1e-4)


def brute_mixing(rows, domain, targets):
    """Lexicons, Gaussian naive Bayes and projected gradient in numpy; rows: id and text, domain: of labelled ids."""
    split = lambda t: [w for w in re.split(r"[\x00-\x26\x28-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    names = sorted(targets)
    marked = [(domain[i], t) for i, t in rows if i in domain]
    count = collections.Counter(d for d, _ in marked)
    has = collections.Counter((d, w) for d, t in marked for w in set(split(t)))
    vocab = {w for _, w in has}
    lexicon = {}
    for d in names:
        n, sure = count[d], {}
        for w in vocab:
            x, y = has[d, w], sum(has[e, w] for e in names) - has[d, w]
            odds = np.log((x + 0.5) / (n + 1)) - np.log((y + 0.5) / (len(marked) - n + 1))
            sure[w] = round(odds / np.sqrt(1 / (x + 0.5) + 1 / (y + 0.5)), 9)
        lexicon[d] = set(sorted((w for w in vocab if sure[w] >= mixing.CERTAIN), key=lambda w: (-sure[w], w))[: mixing.LEXICON])

    def features(t):
        t, w = t or "", split(t)
        n = len(words(t))
        one, chars = max(n, 1), max(len(t), 1)
        of = lambda marks, size: np.log1p(100 * sum(c in marks for c in t) / size)
        return [np.log1p(n), of(mixing.MARKS, chars), of(mixing.CAPITALS, chars), of(".", one), len(set(w)) / one, *[np.log1p(100 * sum(x in lexicon[d] for x in w) / one) if lexicon[d] else 0.0 for d in names]]

    x = np.array([features(t) for _, t in rows])
    tokens = np.array([len(words(t)) for _, t in rows], float)
    logit = np.full((len(rows), len(names)), -1e300)
    for j, d in enumerate(names):
        own = x[[k for k, (i, _) in enumerate(rows) if domain.get(i) == d]]
        if len(own):
            v = np.maximum(own.var(0), 1e-3)
            logit[:, j] = np.log(len(own) / len(marked)) - ((x - own.mean(0)) ** 2 / (2 * v) + 0.5 * np.log(v)).sum(1)
    p = np.exp(logit - logit.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    want = np.array([targets[d] for d in names]) / sum(targets.values())
    rate, total = np.ones(len(rows)), tokens.sum()
    gap, length, best, since = (rate * tokens) @ p / total - want, 1.0, np.inf, 0
    for _ in range(mixing.STEPS):
        far = abs(gap).max()
        best, since = (far, 0) if far < 0.99 * best else (best, since + 1)
        if far < mixing.TOLERANCE or since >= mixing.PATIENCE:
            break
        before, rate = rate, np.maximum(0, rate - length * (p @ gap))
        now = (rate * tokens) @ p / total - want
        bend = ((now - gap) ** 2).sum()
        if bend < 1e-18:
            break
        length, gap = np.clip((tokens * (rate - before) ** 2).sum() / total / bend, 1e-2, 1e4), now
    return lexicon, p, rate


def test_mixing_equals_numpy(spark):
    r = random.Random(3)
    rows = []
    for i in range(150):
        kind = i % 3
        base = r.choices(["river", "stone", "lamp", "paper", "house", "green"], k=r.randint(10, 60))
        if kind == 1:
            base += r.choices(["#buy", "now!!", "click"], k=8)
        if kind == 2 and i % 2:
            base += r.choices(["foul", "nasty"], k=5)
        r.shuffle(base)
        rows.append((i, " ".join(base) + "." * (i % 5)))
    rows += [(150, None), (151, ""), (152, "ÄÖ straße")]
    domain = {i: ("good", "poor", "toxic")[i % 3] for i in range(0, 150)}
    labels = spark.createDataFrame([(i, int(d == "good"), int(d == "toxic")) for i, d in domain.items()] + [(0, 0, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    domain[0] = "poor"
    lexicon, p, rate = brute_mixing(rows, domain, mixing.TARGETS)
    assert lexicon["toxic"] >= {"foul", "nasty"}
    got = {x.doc_id: x for x in mixing.rates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("rate", F.lit(9)), labels).collect()}
    for k, (i, _) in enumerate(rows):
        assert [got[i][f"p_{d}"] for d in sorted(mixing.TARGETS)] == pytest.approx(p[k].tolist(), abs=2e-5)
        assert got[i].rate == pytest.approx(rate[k], abs=2e-3)
    odd = mixing.rates(spark.createDataFrame(rows, "doc_id long, text string"), labels.filter("toxic = 0"), {"good": 0.5, "toxic": 0.5}).first()
    assert odd.gap > 0.4


def kn(train, order):
    """Modified Kneser-Ney by dictionaries: a function from an n-gram to its last character's probability."""
    levels = {order: collections.Counter(train)}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    info = {}
    for k, c in levels.items():
        d = quality_lm.discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)])
        total, left = collections.Counter(), collections.Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]
        info[k] = d, total, left

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / (len(levels[1]) + 1)
        d, total, left = info[k]
        if not total[g[:-1]]:
            return below
        n = levels[k][g]
        return (max(n - d[min(n, 3) - 1], 0) if n else 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * below

    return p


def test_kneser_ney_equals_dictionaries(spark, docs):
    framed = lambda t: [1] * 2 + [48 if 48 <= c <= 57 else 32 if 9 <= c <= 13 else c for c in map(ord, t or "")] + [2]
    grams = lambda t: [tuple(s[i : i + 3]) for s in [framed(t)] for i in range(len(s) - 2)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    held = {r.doc_id for r in labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).collect()}
    texts = dict(corpus())
    p = kn([g for i in range(40) if i not in held for g in grams(texts[i])], 3)
    assert sum(p((116, 104, c)) for c in {g[-1] for i in range(40) for g in grams(texts[i])}) <= 1.0001
    nats = {i: -sum(np.log(p(g)) for g in grams(t)) for i, t in texts.items() if len(t or "") < 5000}
    count = {i: len(grams(t)) for i, t in texts.items()}
    lang = {i: ("en", "de", "")[i % 3] for i in texts}
    mean = {x: sum(nats[i] for i in held if lang[i] == x) / sum(count[i] for i in held if lang[i] == x) for x in ("en", "de", "")}
    got = {r.doc_id: r for r in quality_lm.perplexities(docs, labels, order=3, block_bytes=5000).collect()}
    for i, v in nats.items():
        assert got[i].perplexity == pytest.approx(np.exp((v + quality_lm.PRIOR * mean[lang[i]]) / (count[i] + quality_lm.PRIOR)), rel=1e-4)
    assert all(r.kept for r in quality_lm.perplexities(docs, labels.limit(0), order=3).collect())


def test_quality_limit_of_few_documents(spark, docs):
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    held = {r.doc_id for r in labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).collect()}
    got = quality_lm.perplexities(docs, labels, order=3).collect()
    for lang in ("en", "de", ""):
        worst = max(r.perplexity for r in got if r.doc_id in held and r.lang == lang)
        (limit,) = {r.limit for r in got if r.lang == lang}
        assert worst <= limit <= worst * np.exp(quality_lm.SLACK + 1.1 / quality_lm.BINS)


def test_quality_verdicts_and_row_keys(spark, docs):
    """kept is what perplexities and limits say; equal texts have equal figures in any order of the rows and any blocks."""
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    one = {r.doc_id: r for r in quality_lm.perplexities(docs, labels, order=3, block_bytes=3000).collect()}
    two = {r.doc_id: r for r in quality_lm.perplexities(docs.orderBy(F.xxhash64("doc_id")), labels, order=3, block_bytes=50_000).collect()}
    assert {i: (r.perplexity, r.kept) for i, r in one.items()} == {i: (r.perplexity, r.kept) for i, r in two.items()}
    assert all(r.kept == (r.perplexity <= r.limit + 1e-6) for r in one.values() if abs(r.perplexity - r.limit) > 1e-5)
    noise = "".join(random.Random(1).choices("qxzjkvw#%", k=3000))
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(None, noise, "en"), (9000, noise, "en"), (9000, corpus()[1][1], "en"), (None, corpus()[0][1], "en")], "doc_id long, text string, lang string"))
    kept = quality_lm.keep_good(rows.withColumn("key", F.lit("clash")), labels).collect()
    assert all(r.text != noise for r in kept)
    assert sum(r.doc_id == 9000 for r in kept) == 1
    assert sum(r.doc_id is None for r in kept) == 1


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, name, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    run = {
        "op1_warc_fixity_audit": lambda: warc_audit.drill(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))),
        "op5_chat_formatting": lambda: chat_format.preference_pairs(chat_format.swapped(none.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("lang").alias("role"), "text"))),
        "op2_quality_classifier": lambda: quality_lm.perplexities(none, labels), "op3_ngram_jaccard_join": lambda: ngram_join.jaccard_components(none), "op4_mixing": lambda: mixing.rates(none, labels), "op6_pii": lambda: pii.personal_data(none),
        "op7_quality_rules": lambda: quality_rules.judge(none, labels), "op8_url_filter": lambda: url_filter.judge(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))), "op9_line_dedup": lambda: line_dedup.duplicate_lines(none),
        "op10_benchmark_decontamination": lambda: decontaminate.contamination(none, none.select(F.col("doc_id").alias("item_id"), "text")),
    }
    assert run[name]().count() == 0


def brute_pipeline(rows, items):
    """Stages 2 to 4 over (id, text) by plain Python; stage 1 keeps all where nothing is labelled, stage 5 adds rates."""
    want, _ = brute_lines([((k, i), t) for k, (i, t) in enumerate(rows)])
    left = []
    for k, (i, t) in enumerate(rows):
        drop = want[k, i]
        text = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in drop) if drop else t
        if not drop or words(text):
            left.append((i, text))
    sets = []
    for _, t in left:
        w = words(lower(t))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    pairs = [(a, b) for a in range(len(left)) for b in range(a) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    root, best = union_find(pairs, range(len(left))), {}
    for k, (i, _) in enumerate(left):
        r = root[k]
        if r not in best or (i is None, i or 0) < (left[best[r]][0] is None, left[best[r]][0] or 0):
            best[r] = k
    left = [x for k, x in enumerate(left) if best[root[k]] == k or not sets[k]]
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {tuple(w[j : j + 13]) for t in items if (w := alnum(t)) for j in range(max(1, len(w) - 12))}
    out = []
    for i, t in left:
        w = alnum(t)
        hit = {x for p in windows for j in range(len(w) - len(p) + 1) if tuple(w[j : j + len(p)]) == p for x in range(j, j + len(p))}
        if not hit or 20 * len(hit) < len(w):
            out.append((i, len(words(t))))
    return sorted(out, key=str)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_equals_plain_python(spark, tmp_path, empty):
    import corpus_pipeline

    r = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(r.choices(vocab, k=n))
    item = prose(30)
    rows = [(i, "\n".join(prose(r.randint(8, 25)) for _ in range(r.randint(1, 4)))) for i in range(25)]
    rows += [(30, rows[3][1].replace(" ", "  ", 3) + "\n" + prose(5)), (31, prose(40) + " " + item), (32, prose(900) + " " + " ".join(item.split()[:13])), (33, None), (34, ""), (35, "short"), (36, "short"), (None, prose(30)), (37, rows[5][1] + " " + prose(2)), (4, prose(20)), (38, prose(6000))]
    rows = [] if empty else rows
    docs = spark.createDataFrame([(i, t, None if (i or 0) % 5 == 0 else "en", "s", len(t or ""), "c", "c", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, dropped string, component int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else [(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(((x.doc_id, x.n_tokens) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert got == ([] if empty else brute_pipeline(rows, [item]))
