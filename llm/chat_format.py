"""Preference formatting: chosen and rejected conversations share their longest common turn prefix as prompt (operator 5).

The prompt is rendered once; each side's remaining turns are its completion. A completion's mask lists the spans, in code
points of the completion, that the assistant's turns fill: only they are to be learned.

Defined results: turns are ordered by number, then role, then text, so ties and repeated rows keep a fixed place; null
roles and texts count as empty; identical conversations leave both completions empty (status identical); a conversation
without its partner has an empty prompt and no other side (status unpaired). Rows without a conversation id are no part of
any conversation. Other columns are ignored. A conversation becomes one string, so it must fit a task, and nothing larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import table, with_ids

LEARNED = "assistant"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _mask(turns: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        head = acc["at"] + F.length(turn["role"]) + 5  # <| role |> newline
        end = acc["at"] + F.length(rendered(turn))
        spans = F.when(turn["role"] == LEARNED, F.concat(acc["spans"], F.array(F.concat_ws(":", head.cast("string"), (end - 1).cast("string"))))).otherwise(acc["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def preference_pairs(turns: DataFrame, pair: str = "pair_id", side: str = "side", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each pair: turns holds the rows of both conversations, side being 0 for chosen and 1 for rejected."""
    own = with_ids(turns, pair, side, conv, turn, role, text).filter(F.col(conv).isNotNull())
    entry = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col(side) == s, entry)))
    ids = lambda s, name: F.min(F.when(F.col(side) == s, F.col(conv))).alias(name)
    pairs = own.groupBy(F.col(pair).alias("pair_id")).agg(ids(0, "chosen_id"), ids(1, "rejected_id"), of(0).alias("a"), of(1).alias("b"))
    same = lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"])
    differs = F.zip_with(F.slice("a", 1, F.least(F.size("a"), F.size("b"))), F.slice("b", 1, F.least(F.size("a"), F.size("b"))), lambda x, y: ~same(x, y))
    at = F.array_position(differs, True)
    pairs = pairs.withColumn("n_prompt", F.when(at == 0, F.least(F.size("a"), F.size("b")).cast("long")).otherwise(at - 1))
    rest = lambda c: F.slice(c, (F.col("n_prompt") + 1).cast("int"), F.greatest(F.size(c), F.lit(1)))
    status = F.when(F.col("chosen_id").isNull() | F.col("rejected_id").isNull(), "unpaired").when((F.size(rest("a")) == 0) & (F.size(rest("b")) == 0), "identical").otherwise("pair")
    there = lambda c, x: F.when(F.col(c).isNotNull(), x)
    return pairs.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt", status.alias("status"),
        _joined(F.slice("a", 1, F.col("n_prompt").cast("int"))).alias("prompt"),
        there("chosen_id", _joined(rest("a"))).alias("chosen"), there("chosen_id", _mask(rest("a"))).alias("chosen_mask"),
        there("rejected_id", _joined(rest("b"))).alias("rejected"), there("rejected_id", _mask(rest("b"))).alias("rejected_mask"),
    )


def swapped(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns of pairs: each conversation as chosen, and with its last turn's text taken from the next one's as rejected.

    Conversations are numbered; where the next number is missing, the rejected side has no last turn at all. Its ids are
    those of the chosen side. Of several last turns (by turn, role, text) each is replaced.
    """
    own = with_ids(turns, conv, turn, role, text).toDF("conv_id", "turn", "role", "text").filter("conv_id is not null")
    last = own.groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("last")).alias("last"))
    ends = last.select(F.col("conv_id").alias("pair_id"), F.col("last.turn").alias("end"))
    nexts = last.select((F.col("conv_id") - 1).alias("pair_id"), F.col("last.col3").alias("other"))
    own = own.withColumn("pair_id", F.col("conv_id"))
    rejected = own.join(ends, "pair_id").join(nexts, "pair_id", "left").filter(~F.col("turn").eqNullSafe(F.col("end")) | F.col("other").isNotNull())
    rejected = rejected.withColumn("text", F.when(F.col("turn").eqNullSafe(F.col("end")), F.col("other")).otherwise(F.col("text")))
    side = lambda df, n: df.select("pair_id", F.lit(n).alias("side"), "conv_id", "turn", "role", "text")
    return side(own, 0).union(side(rejected, 1))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is the chosen one of a pair; in the rejected one the last answer is the next conversation's."""
    return preference_pairs(swapped(table(spark, sf_dir, "conversations")))


_SHOWN = "'<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)"
_MASK = "coalesce(array_to_string([CAST(coalesce(list_sum({l}[1 : i - 1]), 0) + len({r}[i].role) + 5 AS BIGINT) || ':' || CAST(list_sum({l}[1 : i]) - 1 AS BIGINT) FOR i IN range(1, len({r}) + 1) IF {r}[i].role = 'assistant'], ','), '')"
SQL = {
    "op5_chat_formatting": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last, arg_max(text, (turn, role, text)) AS answer FROM c GROUP BY conv_id),
s AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM c
  UNION ALL
  SELECT c.conv_id, 1, turn, role, CASE WHEN turn = l.last THEN n.answer ELSE text END
  FROM c JOIN l ON c.conv_id = l.conv_id LEFT JOIN l n ON n.conv_id = c.conv_id + 1 WHERE turn <> l.last OR n.answer IS NOT NULL),
g AS (
  SELECT pair_id, bool_or(side = 0) AS has_a, bool_or(side = 1) AS has_b,
    coalesce(list_sort(list({{'turn': turn, 'role': role, 'text': text}}) FILTER (WHERE side = 0)), []) AS a,
    coalesce(list_sort(list({{'turn': turn, 'role': role, 'text': text}}) FILTER (WHERE side = 1)), []) AS b
  FROM s GROUP BY 1),
n AS (
  SELECT *, CAST(coalesce(list_min([i FOR i IN range(1, least(len(a), len(b)) + 1) IF a[i].role <> b[i].role OR a[i].text <> b[i].text]) - 1, least(len(a), len(b))) AS BIGINT) AS n_prompt FROM g),
r AS (SELECT *, a[n_prompt + 1 :] AS ra, b[n_prompt + 1 :] AS rb, a[1 : n_prompt] AS p FROM n),
m AS (SELECT *, [len({_SHOWN}) FOR x IN ra] AS la, [len({_SHOWN}) FOR x IN rb] AS lb FROM r)
SELECT pair_id, CASE WHEN has_a THEN pair_id END AS chosen_id, CASE WHEN has_b THEN pair_id END AS rejected_id, n_prompt,
  CASE WHEN NOT (has_a AND has_b) THEN 'unpaired' WHEN len(ra) = 0 AND len(rb) = 0 THEN 'identical' ELSE 'pair' END AS status,
  coalesce(array_to_string([{_SHOWN} FOR x IN p], ''), '') AS prompt,
  CASE WHEN has_a THEN coalesce(array_to_string([{_SHOWN} FOR x IN ra], ''), '') END AS chosen,
  CASE WHEN has_a THEN {_MASK.format(l='la', r='ra')} END AS chosen_mask,
  CASE WHEN has_b THEN coalesce(array_to_string([{_SHOWN} FOR x IN rb], ''), '') END AS rejected,
  CASE WHEN has_b THEN {_MASK.format(l='lb', r='rb')} END AS rejected_mask
FROM m
"""
}
