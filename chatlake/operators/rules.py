"""Text that tools put into conversations: rules by session, metadata, prefix and leading blocks, and a dry-run plan.

Messages have source (codex, claude, dsh, gemini), conversation, event_id, speaker and text; metadata is a JSON string.
Rules are literal columns, so all but the block stripper stay inside the JVM's generated code.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from chatlake.functions.text import mask_credentials

# Names, sources, marks and actions that stored decisions refer to.
METADATA = [
    ("codex_subagent_source", ("codex",), "$.source.subagent", "skip_session"),
    ("claude_sidechain", ("claude",), "$.isSidechain", "skip_session"),
    ("claude_is_meta", ("claude",), "$.isMeta", "skip_message"),
    ("claude_compact_summary_flag", ("claude",), "$.isCompactSummary", "skip_message"),
]
PREFIXES = [
    ("codex_guardian_history", ("codex",), "The following is the Codex agent history", "skip_session"),
    ("codex_agents_md", ("codex",), "# AGENTS.md instructions", "skip_message"),
    ("continued_conversation_summary", ("codex", "claude", "dsh"), "This session is being continued from a previous conversation", "skip_message"),
    ("codex_turn_aborted", ("codex",), "<turn_aborted>", "skip_message"),
    ("claude_caveat", ("claude",), "Caveat: the following content is system generated", "skip_message"),
    ("dsh_runtime_context", ("dsh",), "Current runtime context", "skip_message"),
    ("dsh_skills_preamble", ("dsh",), "The following skills are available in this session:", "skip_message"),
]
TAGS = [
    ("system_reminder_block", ("claude", "dsh"), "system-reminder"),
    ("command_name_block", ("claude",), "command-name"),
    ("command_message_block", ("claude",), "command-message"),
    ("command_args_block", ("claude",), "command-args"),
    ("local_command_stdout_block", ("claude",), "local-command-stdout"),
    ("claude_task_notification_block", ("claude",), "task-notification"),
    ("recommended_plugins_block", ("codex", "claude", "dsh"), "recommended_plugins"),
    ("environment_context_block", ("codex", "claude", "dsh"), "environment_context"),
    ("subagent_notification_block", ("codex", "claude", "dsh"), "subagent_notification"),
    ("skills_list_block", ("dsh",), "available_skills"),
]
LABEL, LABEL_RULE, IMPORT_RULE = "你说", "gemini_label_dup", "codex_imported_thread"
# End of the fixed values.
SESSION_RULES = [n for n, _, _, action in (*METADATA, *PREFIXES) if action == "skip_session"] + [IMPORT_RULE]
#: Space at the ends of a text, ideographic space included.
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"


def _first(cases: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(found, F.lit(name)) for name, found in cases])


def metadata_rule(source: Column, metadata: Column) -> Column:
    """The first rule whose field of the JSON metadata is set to something that counts as true, or null."""
    value = lambda path: F.get_json_object(metadata, path)
    truthy = lambda path: F.coalesce(~F.lower(value(path)).isin("", "false", "0", "null", "{}", "[]"), F.lit(False))
    return _first([(name, source.isin(*sources) & truthy(path)) for name, sources, path, _ in METADATA])


def left_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_SPACE}+", "")


def prefix_rule(source: Column, text: Column) -> Column:
    """The first rule whose prefix begins the text behind its leading space, or null."""
    head = left_trimmed(text)
    return _first([(name, source.isin(*sources) & head.startswith(prefix)) for name, sources, prefix, _ in PREFIXES])


_BLOCKS = {
    source: [(name, re.compile(rf"\s*<{re.escape(tag)}(?:\s+[^>]*)?>.*?</{re.escape(tag)}\s*>\s*", re.I | re.S)) for name, sources, tag in TAGS if source in sources]
    for source in ("codex", "claude", "dsh", "gemini")
}


def stripped(source: str, text: str) -> tuple[str, list[str]]:
    """The text behind its leading complete blocks, and the rules of these; blocks further on and open ones stay."""
    names, at = [], 0
    while hit := next(((name, m) for name, block in _BLOCKS.get(source, ()) if (m := block.match(text, at))), None):
        names.append(hit[0])
        at = hit[1].end()
    return text[at:].strip(), names


@F.pandas_udf(StructType([StructField("rest", StringType()), StructField("rules", ArrayType(StringType()))]))
def leading_blocks(source: pd.Series, text: pd.Series) -> pd.DataFrame:
    found = [(None, None) if t is None else stripped(s, t) for s, t in zip(source, text, strict=True)]
    return pd.DataFrame({"rest": [r for r, _ in found], "rules": [n for _, n in found]})


def cleaned(rows: DataFrame, source: str = "source", text: str = "text", metadata: str | None = None) -> DataFrame:
    """rows with clean (null: not to be imported) and rule (why, or null).

    A message goes by its metadata, a prefix, or if nothing is left behind its blocks; what is left is tested for a prefix
    again. Only texts that begin with a block reach the Python worker's pattern.
    """
    src, own = F.col(source), F.col(text)
    skips = [n for n, _, _, action in METADATA if action == "skip_message"]
    meta = metadata_rule(src, F.col(metadata)) if metadata else F.lit(None).cast("string")
    rows = rows.withColumn("_rule", F.coalesce(F.when(meta.isin(*skips), meta), prefix_rule(src, own)))
    block = F.when(left_trimmed(own).startswith("<"), leading_blocks(src, own))
    rows = rows.withColumn("_rest", F.coalesce(block["rest"], F.regexp_replace(own, rf"\A{_SPACE}+|{_SPACE}+\z", ""))).withColumn("_blocks", F.coalesce(block["rules"], F.array().cast("array<string>")))
    again = prefix_rule(src, F.col("_rest"))
    gone = F.col("_rule").isNotNull() | (F.col("_rest") == "") | again.isNotNull()
    rule = F.coalesce("_rule", F.when(F.col("_rest") == "", F.get("_blocks", 0)), F.when(F.col("_rest") != "", again))
    return rows.withColumns({"clean": F.when(~gone, F.col("_rest")), "rule": rule}).drop("_rule", "_rest", "_blocks")


def twice(text: str) -> str | None:
    """A of a text A + space + A, with one or two characters of space between, else None."""
    for gap in (1, 2):
        n, odd = divmod(len(text) - gap, 2)
        if n > 0 and not odd and text[:n] == text[n + gap :] and not text[n : n + gap].strip():
            return text[:n]
    return None


def without_label(text: str) -> str:
    """A text without a screen reader's label in front and the repeat of its body.

    A label on a line of its own goes, and so does the repeat behind it; one on the body's line goes only with a repeat.
    """
    head = text.lstrip()
    if not head.startswith(LABEL):
        return text
    rest = head[len(LABEL) :]
    own_line = re.match(r"[：:]?[ \t]*\n", rest)
    body = rest[own_line.end() :].strip() if own_line else rest.strip()
    once = twice(body)
    if once is not None:
        return once
    return body if own_line or not body else text


@F.pandas_udf(StringType())
def unlabelled(text: pd.Series) -> pd.Series:
    return text.map(without_label, na_action="ignore")


def label_rule(text: Column) -> Column:
    return F.when(text.contains(LABEL) & (unlabelled(text) != text), F.lit(LABEL_RULE))


def imported_conversations(threads: DataFrame, thread: str = "imported_thread_id") -> DataFrame:
    """conversation ids, in both of their forms, of threads that were imported from elsewhere."""
    forms = F.array(F.concat(F.lit("codex-"), thread), F.concat(F.lit("codex-"), F.right(F.col(thread), F.lit(12))))
    return threads.filter(F.col(thread).isNotNull()).select(F.explode(forms).alias("conversation")).distinct()


def source_type(namespace: Column, conversation: Column) -> Column:
    """The kind of source that a conversation id's prefix, or its namespace, tells."""
    known = ("codex", "claude", "dsh", "hermes", "gemini")
    return F.coalesce(*[F.when(conversation.startswith(f"{k}-"), F.lit(k)) for k in known], *[F.when(namespace == k, F.lit(k)) for k in known], F.lit("chatgpt"))


def plan(messages: DataFrame, sessions: DataFrame | None = None, threads: DataFrame | None = None) -> DataFrame:
    """Dry run: event_id, source, rule and chars of every owner's message that a rule would withdraw.

    A session rule, a message's own or one of sessions (conversation, rule), or an imported thread marks all of the owner's
    messages in its conversation; else a message's own rule counts. Of several session rules the least name does.
    """
    own = messages.filter("speaker = 'owner'")
    direct = cleaned(own).drop("clean")
    direct = direct.withColumn("rule", F.coalesce("rule", F.when(F.col("source") == "gemini", label_rule(F.col("text")))))
    marks = direct.filter(F.col("rule").isin(*SESSION_RULES)).select("conversation", "rule")
    if sessions is not None:
        marks = marks.unionByName(sessions.select("conversation", "rule"))
    if threads is not None:
        marks = marks.unionByName(imported_conversations(threads).withColumn("rule", F.lit(IMPORT_RULE)))
    marks = marks.groupBy("conversation").agg(F.min("rule").alias("session_rule"))
    found = direct.join(marks, "conversation", "left").withColumn("rule", F.coalesce("session_rule", "rule"))
    return found.filter("rule is not null").select("event_id", "source", "conversation", "rule", F.length("text").alias("chars"), "text", *[c for c in ("created_at",) if c in messages.columns])


def counters(planned: DataFrame) -> DataFrame:
    return planned.groupBy("source", "rule").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


def before_and_after(messages: DataFrame, planned: DataFrame, since: Column) -> DataFrame:
    """Per source: the owner's messages since an instant, those that would go, and those of unknown time, with characters."""
    rows = messages.filter("speaker = 'owner'").join(planned.select("event_id", F.lit(True).alias("gone")), "event_id", "left")
    size, recent, gone = F.length("text"), F.col("created_at") >= since, F.coalesce("gone", F.lit(False))
    unknown = F.col("created_at").isNull()
    each = {"current": recent, "removed": recent & gone, "unknown": unknown, "unknown_removed": unknown & gone}
    return rows.groupBy("source").agg(*[x for name, test in each.items() for x in (F.count_if(test).alias(name), F.coalesce(F.sum(F.when(test, size)), F.lit(0)).alias(f"{name}_chars"))])


def samples(planned: DataFrame, k: int, seed: int = 7, chars: int = 40) -> DataFrame:
    """k samples at most of each source and rule, each text cut and its credentials masked."""
    w = Window.partitionBy("source", "rule").orderBy(F.xxhash64("event_id", F.lit(seed)), "event_id")
    return planned.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).select("source", "rule", "event_id", F.substring(mask_credentials("text"), 1, chars).alias("sample"))
