"""Deterministic ids as columns: what an id is made of is fixed, so the same content always has the same id."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of what is hashed; ids of another archive are matched by giving its prefixes.
FALLBACK, REVISION, CONTENT = "chatlake/fallback", "chatlake/revision", "chatlake/content"
CITATION = "pb:"


def _joined(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def event_id(kind: str, namespace: str, message: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), F.lit(namespace), message)


def content_digest(text: Column, prefix: str = CONTENT) -> Column:
    return F.sha2(F.concat(F.lit(prefix + "|"), F.coalesce(text, F.lit(""))), 256)


def structural_position(parent: Column, child_order: Column) -> Column:
    return _joined(parent, child_order)


def fallback_message_id(kind: str, namespace: str, conversation: Column, position: Column, speaker: Column, time: Column, digest: Column, prefix: str = FALLBACK) -> Column:
    """The id of a message without one of its own: where it stands, who says it when, and what."""
    return F.concat(F.lit("fb-"), F.substring(F.sha2(_joined(F.lit(prefix), F.lit(kind), F.lit(namespace), conversation, position, speaker, time, digest), 256), 1, 24))


def revision_hash(content_type: Column, text: Column, speaker: Column, created: Column, updated: Column, attachments: Column, prefix: str = REVISION) -> Column:
    """Of what a reader would see change; import time and place in the archive are no part of it."""
    fields = F.to_json(F.struct(attachments.alias("attachments"), content_type.alias("content_type"), text.alias("raw_text"), updated.alias("source_updated_at"), speaker.alias("speaker_type"), created.alias("time")), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit(prefix + "|"), fields), 256)


def revision_id(event: Column, hash_: Column) -> Column:
    return F.concat(event, F.lit(":r"), F.substring(hash_, 1, 20))


def citation(revision: Column) -> Column:
    return F.concat(F.lit(CITATION), revision)


def cited_revision(cite: Column) -> Column:
    """The revision id of a citation, or null if it isn't one."""
    return F.nullif(F.regexp_extract(cite, rf"^{CITATION}(.+:r[0-9a-f]{{20}})$", 1), F.lit(""))


def cited_event(cite: Column) -> Column:
    return F.nullif(F.regexp_extract(cite, rf"^{CITATION}(.+):r[0-9a-f]{{20}}$", 1), F.lit(""))


def vault_citation(revision: Column, path: Column) -> Column:
    return F.concat_ws(":", F.lit("pb:vault"), revision, path)


def conversation_snapshot(snapshot: Column, conversation: Column) -> Column:
    return F.concat(snapshot, F.lit(":"), F.substring(F.sha2(conversation, 256), 1, 12))


def node_key(conversation: Column, node: Column) -> Column:
    return F.concat_ws("::", conversation, node)


def name_uuid(*parts: str) -> str:
    """UUIDv5 of sources and snapshots."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, "|".join(parts)))


def index_version(parameters: dict[str, object], quantised: str | None = None) -> str:
    """Sixteen digits for the parameters of a vector index, and eight more for how it is packed."""
    text = "|".join(f"{k}={parameters[k]}" for k in sorted(parameters))
    own = hashlib.sha1(text.encode()).hexdigest()[:16]
    return own if quantised is None else f"{own}-{hashlib.sha1(f'{text}|{quantised}'.encode()).hexdigest()[:8]}"
