"""Soft-membership mixing of documents to target domain weights (operator 4), with DataFrame functions only.

A classifier learned from FIT of the labelled documents, or all if there are fewer, gives each document posteriors of the
domains; which ones is decided by a hash of the id. Each domain has a lexicon:
the words whose share of labelled documents is most surely higher in it than in the other domains. The words of a document that lie
in each lexicon, and a few figures of its form, are the features of a Gaussian naive Bayes model, fitted by one aggregation.
Nonnegative document rates, all 1 at first, are then moved by projected gradient steps until the expected tokens of each
domain, sum of rate * tokens * posterior, match the targets in least squares. A step needs one aggregation of as many
numbers as there are domains; its length follows Barzilai and Borwein. The gradient is taken in the norm that weighs
documents by their tokens, so a rate depends on what a document is and not on its length.

The steps go on until every domain is within TOLERANCE of its target, or no rate moves any more or PATIENCE steps bring
nothing (a target can't be met), or STEPS are done; gap says how far the worst domain is from its target then, as a share of all tokens.

Defined results: a null or empty text has 0 tokens and the rate of its posteriors; domains without labelled documents
have posterior 0, and their target can't be met; without any labelled document all posteriors are equal. Repeated rows count
each. A document with several labels is labelled by the worst (toxic before poor before good). Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Scratch, table, with_ids

#: Share of the tokens that each domain is to have.
TARGETS = {"good": 0.88, "poor": 0.07, "toxic": 0.05}
#: Target tokens of all domains together, as a share of the tokens there are.
BUDGET = 1.0
STEPS, TOLERANCE, WRITE_EVERY = 200, 1e-5, 4
#: Steps in which the worst gap must have shrunk by a hundredth.
PATIENCE = 12
#: Labelled documents that the classifier is fitted to at most, those of the least hashes.
FIT = 20_000
#: Words of a lexicon at most, and the least of standard errors that a word's log odds must be from 0.
LEXICON, CERTAIN = 100, 3.0
FORM = ("words", "symbols", "capitals", "stops", "varied")
MARKS, CAPITALS = "#*$%&|<>!", "A-Z"


def words_of(text: Column) -> Column:
    """Lower-cased words, ASCII letters, apostrophes and all beyond ASCII; empty strings are among them."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x26\x28-\x60\x7B-\x7F]+")


def features(rows: DataFrame, lexicons: dict[str, list[str]]) -> DataFrame:
    """id, tokens and the classifier's features of rows of id and text. Each text is gone through three times in all."""
    text = F.coalesce("text", F.lit(""))
    marks = F.regexp_replace(text, f"[^{MARKS}{CAPITALS}.]+", "")
    rows = rows.select("id", F.length(text).alias("chars"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"), marks.alias("marks"), words_of(F.col("text")).alias("words"))
    every = sorted({w for known in lexicons.values() for w in known})
    hits = F.filter("words", lambda w: w.isin(*every)) if every else F.slice("words", 1, 0)
    rows = rows.select("id", "tokens", "chars", "marks", F.size(F.array_remove(F.array_distinct("words"), "")).alias("distinct"), hits.alias("hits"))
    one, chars = F.greatest("tokens", F.lit(1)), F.greatest("chars", F.lit(1))
    rate = lambda kind, of: F.log1p(100 * F.regexp_count("marks", F.lit(f"[{kind}]")) / of)
    inside = lambda known: F.log1p(100 * F.size(F.filter("hits", lambda w: w.isin(*known))) / one) if known else F.lit(0.0)
    return rows.select(
        "id", "tokens", F.log1p("tokens").alias("words"), rate(MARKS, chars).alias("symbols"), rate(CAPITALS, chars).alias("capitals"), rate(".", one).alias("stops"), (F.col("distinct") / one).alias("varied"),
        *[inside(known).alias(f"in_{d}") for d, known in lexicons.items()],
    )


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").when(quality == 1, "good")


def marked(labels: DataFrame, id_col: str) -> DataFrame:
    """label_id and domain of the labelled documents that the classifier is fitted to."""
    worst = F.max(F.when(F.col("domain") == "toxic", 2).when(F.col("domain") == "poor", 1).otherwise(0))
    known = with_ids(labels, id_col, "quality", "toxic").select(F.col(f"`{id_col}`").alias("label_id"), domain(F.col("quality"), F.col("toxic")).alias("domain")).filter("domain is not null")
    known = known.groupBy("label_id").agg(F.element_at(F.array(*map(F.lit, ("good", "poor", "toxic"))), worst + 1).alias("domain"))
    return known.orderBy(F.xxhash64("label_id"), "label_id").limit(FIT)


def lexicons_of(own: DataFrame, known: DataFrame, domains: list[str], work: Scratch) -> dict[str, list[str]]:
    """For each domain its LEXICON words of the surest log odds, over the labelled documents; only these reach the driver.

    A word counts once a document. Ties go by the word.
    """
    labelled = own.join(F.broadcast(known), own["id"] == known["label_id"])
    rows = labelled.select("domain", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).filter("word <> ''")
    many = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    total = sum(many.values())
    table_ = rows.groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in domains], F.count(F.lit(1)).alias("every"))
    table_, out = work.write(table_.filter(F.col("every") >= CERTAIN), "words"), {}  # rarer words can't be sure
    for d in domains:
        n = many.get(d, 0)
        odds = F.log((F.col(d) + 0.5) / (n + 1.0)) - F.log((F.col("every") - F.col(d) + 0.5) / (total - n + 1.0))
        sure = F.round(odds / F.sqrt(1 / (F.col(d) + 0.5) + 1 / (F.col("every") - F.col(d) + 0.5)), 9)
        best = table_.select("word", sure.alias("sure")).filter(F.col("sure") >= CERTAIN).orderBy(F.col("sure").desc(), "word").limit(LEXICON)
        out[d] = sorted(r["word"] for r in best.collect())
    return out


def posteriors(rows: DataFrame, known: DataFrame, domains: list[str]) -> list[Column]:
    """One column for each domain; the fitted means and variances are as many numbers as domains times features."""
    names = [*FORM, *[f"in_{d}" for d in domains]]
    known = rows.join(F.broadcast(known), rows["id"] == known["label_id"])
    fitted = {r["domain"]: r for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{x}_{n}") for x in names for f, n in ((F.avg, "m"), (F.var_pop, "v"))]).collect()}
    total = sum(r["n"] for r in fitted.values())
    if not total:
        return [F.lit(1.0 / len(domains)) for _ in domains]

    def logit(d: str) -> Column:
        if d not in fitted:
            return F.lit(-1e300)
        r, out = fitted[d], F.lit(math.log(fitted[d]["n"] / total))
        for x in names:
            v = max(r[f"{x}_v"], 1e-3)
            out = out - (F.col(x) - r[f"{x}_m"]) ** 2 / (2 * v) - 0.5 * math.log(v)
        return out

    each = F.array(*[logit(d) for d in domains])
    top = F.array_max(each)
    return [F.exp(logit(d) - top) / F.aggregate(each, F.lit(0.0), lambda s, x: s + F.exp(x - top)) for d in domains]


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """id_col, n_tokens, p_<domain> for each domain, rate and gap, for every row of docs."""
    targets = TARGETS if targets is None else targets
    domains = sorted(targets)
    work = Scratch(docs.sparkSession, "mixing")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = work.write(marked(labels, id_col), "known")
    rows = work.write(features(own, lexicons_of(own, known, domains, work)), "features")
    posterior = posteriors(rows, known, domains)
    p = [f"p_{d}" for d in domains]
    state = work.write(rows.select("id", "tokens", *[c.alias(n) for n, c in zip(p, posterior, strict=True)], F.lit(1.0).alias("rate")), "state")
    sums = lambda rate: [F.sum(rate * F.col("tokens") * F.col(n)).alias(n) for n in p]
    first = state.agg(F.sum("tokens").alias("tokens"), *sums(F.col("rate"))).first()
    total = first["tokens"] or 0
    weight, worst = sum(targets.values()), None
    if total and weight:
        want = [targets[d] / weight * budget for d in domains]
        gap = [first[n] / total - w for n, w in zip(p, want, strict=True)]
        rate, length, best, since = F.col("rate"), 1.0, math.inf, 0
        for step in range(1, steps + 1):
            far = max(map(abs, gap))
            best, since = (far, 0) if far < 0.99 * best else (best, since + 1)
            if far < TOLERANCE or since >= PATIENCE:
                break
            before, slope = rate, reduce(lambda s, x: s + x, [F.col(n) * g for n, g in zip(p, gap, strict=True)])
            rate = F.greatest(F.lit(0.0), before - length * slope)
            got = state.agg(*sums(rate), F.sum(F.col("tokens") * (rate - before) ** 2).alias("moved")).first()
            now = [got[n] / total - w for n, w in zip(p, want, strict=True)]
            bend = sum((a - b) ** 2 for a, b in zip(now, gap, strict=True))
            if bend < 1e-18:  # no rate moves any more
                break
            length, gap = min(max(got["moved"] / total / bend, 1e-2), 1e4), now
            if step % WRITE_EVERY == 0:
                state = work.write(state.select("id", "tokens", *p, rate.alias("rate")), f"state-{step}")
                work.drop("state" if step == WRITE_EVERY else f"state-{step - WRITE_EVERY}")
                rate = F.col("rate")
        state, worst = state.select("id", "tokens", *p, rate.alias("rate")), max(map(abs, gap))
    return state.select(F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"), *[F.round(n, 6).alias(n) for n in p], F.round("rate", 6).alias("rate"), F.lit(worst).cast("double").alias("gap"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
