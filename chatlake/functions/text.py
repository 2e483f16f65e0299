"""Text functions on columns: normal form, matches, bigrams, tokens, chunks, snippets and masking of credentials."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The ranges of Chinese characters that are cut into bigrams.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
#: Shapes of credentials; our own list.
CREDENTIALS = [
    r"sk-(?:proj-|ant-)?[A-Za-z0-9_-]{8,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"(?i:api[_-]?key|token|secret|password)\s*[=:]\s*[\"']?[A-Za-z0-9_./+-]{8,}[\"']?",
]
CREDENTIAL = "|".join(CREDENTIALS)
#: Texts of a batch that are Python's strings at a time.
LOT = 256
_credential = re.compile(CREDENTIAL)
_runs = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f]+")


def normal(text: str) -> str:
    """NFKC and case folding of each character by itself, so that offsets can be mapped back."""
    if text.isascii():
        return text.lower()
    return "".join(unicodedata.normalize("NFKC", c).casefold() for c in text)


def in_lots(text: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """change of each text but null. Only LOT texts at a time are Python's strings, the rest of the batch stays in Arrow."""
    lots = (text.slice(i, LOT).to_pylist() for i in range(0, len(text), LOT))
    done = [pa.array([None if t is None else change(t) for t in lot], text.type) for lot in lots]
    return pa.concat_arrays(done) if done else text


@F.arrow_udf(StringType())
def _normalized(text: pa.Array) -> pa.Array:
    return in_lots(text, normal)


def normalize(text: Column | str) -> Column:
    """normal() of a column. Spark itself lower-cases texts in ASCII, which have as many bytes as characters; Python gets the others only."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(_normalized(F.when(~plain, text)))


def normal_map(text: str) -> tuple[str, list[int]]:
    """The normal form, and for each of its characters the place of the raw one; one more for the end."""
    parts = [normal(c) for c in text]
    offsets = [i for i, p in enumerate(parts) for _ in p]
    return "".join(parts), [*offsets, len(text)]


def cjk_runs(text: str) -> list[str]:
    return _runs.findall(text)


def bigrams_of(term: str) -> list[str]:
    return [term] if len(term) < 2 else [term[i : i + 2] for i in range(len(term) - 1)]


def masked_text(text: str) -> str:
    """The text with a block for each character of a credential, as long as before."""
    return _credential.sub(lambda m: "█" * len(m[0]), text)


def raw_span(text: str, start: int, end: int) -> tuple[int, int]:
    """The span of the raw text behind a span of its normal form."""
    at, begin, stop = 0, len(text), len(text)
    for i, c in enumerate(text):
        size = len(normal(c))
        if at <= start < at + size:
            begin = i
        if at < end <= at + size:
            stop = i + 1
            break
        at += size
    return begin, stop


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term)))) / len(term)).cast("long")


def first_at(text: Column, term: str) -> Column:
    return (F.instr(text, term) - 1).cast("long")


def bigrams(term: Column) -> Column:
    """Overlapping pairs of characters; a single character is itself."""
    return F.when(F.length(term) < 2, F.array(term)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(term) - 1, F.lit(1))), lambda i: F.substring(term, i, F.lit(2))))


def index_tokens(text: Column) -> Column:
    """Bigrams of runs of Chinese characters, and whole words of other letters and digits."""
    runs = F.regexp_extract_all(text, F.lit(rf"[{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.when(r.rlike(rf"^[{CJK}]"), bigrams(r)).otherwise(F.array(r)))))


def chunk_spans(text: Column, size: int = 600, overlap: int = 100) -> Column:
    """Half-open spans of at most size characters, each step size - overlap on; a short text is one, an empty one none."""
    n, step = F.length(text), size - overlap
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).cast("long").alias("start"), F.least(n, i * step + size).cast("long").alias("end")))
    return F.when(n > 0, spans).otherwise(F.slice(spans, 1, 0))


def has_credentials(text: Column) -> Column:
    return F.coalesce(text.rlike(CREDENTIAL), F.lit(False))


@F.arrow_udf(StringType())
def mask_credentials(text: pa.Array) -> pa.Array:
    return in_lots(text, masked_text)


def snippet(text: Column, start: Column, width: int = 80) -> Column:
    """A window of width characters around an offset, with marks where it is cut."""
    begin = F.greatest(start - width // 2, F.lit(0))
    return F.concat(F.when(begin > 0, "…").otherwise(""), F.substring(text, (begin + 1).cast("int"), F.lit(width)), F.when(begin + width < F.length(text), "…").otherwise(""))


def bigram_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(bigrams(a)), F.array_distinct(bigrams(b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
