"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score (operator 6).

Base kinds follow fixed patterns: email, ip (parts up to 255), card (13 to 19 digits, Luhn), phone (a plus sign, 9 to 15
digits). The method adds two kinds: iban (mod-97) and local_phone, numbers with a leading zero and no plus sign, which
only stand when a context word near them lifts their score to ACCEPT. Base spans stay whatever their score.

Defined results: a null or empty text has no spans; repeated rows give repeated results; other columns are ignored.
Every pattern is written so that its time is linear in the text, whatever the runs of letters or digits in it.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import batch_of, table, with_ids

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local_phone")
#: Characters before and after a span that count as near.
NEAR = 48
ACCEPT = 0.6
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "local_phone": 0.4}
#: Words near a span that speak for its kind, or against any.
FOR = {
    "email": {"mail", "email", "e-mail", "contact", "kontakt", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "adresse", "login"},
    "card": {"card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "téléphone"},
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta"},
    "local_phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "téléphone"},
}
AGAINST = {"version", "isbn", "issn", "invoice", "order", "sku", "page"}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits starts: nothing inside a run can match when its start doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])0[0-9](?:[ ./-]?[0-9]){6,12}(?![\w-])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain with a dot, found from each @: the leftmost match begins where the run before it begins."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(filter(str.isdigit, s))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Candidates may have run on into following capitals; the longest confirmed cut before a blank counts."""
    for m in _IBAN.finditer(text):
        for end in [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " ")]:
            compact = text[m.start() : end].replace(" ", "")
            if 15 <= len(compact) <= 34 and mod97(compact):
                yield m.start(), end
                break


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def score(text: str, kind: str, begin: int, end: int) -> float:
    near = {w.lower() for side in (text[max(0, begin - NEAR) : begin], text[end : end + NEAR]) for w in _WORD.findall(side)}
    return round(START[kind] + 0.3 * bool(near & FOR[kind]) - 0.3 * bool(near & AGAINST), 2)


class Taken:
    """Spans by start, with the furthest end up to each, to tell in logarithmic time whether a span overlaps one of them."""

    def __init__(self, spans: list[tuple[str, int, int, float]]):
        self.starts = sorted(a for _, a, _, _ in spans)
        self.ends = list(itertools.accumulate((b for _, _, b, _ in sorted(spans, key=lambda s: s[1])), max))

    def free(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        return not i or self.ends[i - 1] <= a


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; ends are exclusive, offsets count code points."""
    spans = [(*s, score(text, *s)) for s in base_spans(text)]
    if _DIGIT.search(text):
        taken = Taken(spans)
        ibans = [("iban", a, b, s) for a, b in _ibans(text) if taken.free(a, b) and (s := score(text, "iban", a, b)) >= ACCEPT]
        taken = Taken(spans := spans + ibans)
        spans += [("local_phone", a, b, s) for a, b in map(re.Match.span, _LOCAL_PHONE.finditer(text)) if taken.free(a, b) and (s := score(text, "local_phone", a, b)) >= ACCEPT]
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def mask(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first by start wins."""
    out, at = [], 0
    for kind, a, b, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and found: the spans of every row's text, with kind, start, end and score."""
    schema = pa.schema([("id", pa.int64()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find(t or "")] for t in (x.as_py() for x in batch.column(1))]
            yield batch_of(schema, batch.column(0), found)

    own = with_ids(docs, id_col, text_col).withColumn(id_col, F.col(id_col).cast("long"))
    return own.mapInArrow(run, "id long, found array<struct<kind:string,start:long,end:long,score:double>>").withColumnRenamed("id", id_col)


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with their personal data masked; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            yield batch.set_column(i, batch.schema.field(i), pa.array([None if t is None else mask(t) for t in (x.as_py() for x in batch.column(i))], batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    of = lambda kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(of(BASE)), 256).alias("base_sha256"),
        joined("found").alias("spans"),
        F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
