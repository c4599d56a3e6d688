"""Readers of the two export formats: a graph of nodes a conversation, and a flat list of messages.

Files are split into conversations, conversations are spread over the cluster, and each is mapped on its own: the
walk from the current node to the root needs the whole of one conversation and nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import ship_sources
from ..functions.local import blank_to_none

GRAPH, FLAT = "chatgpt", "claude"


def text_or_none(value: object) -> str | None:
    """A string as it is, or nothing."""
    return value if isinstance(value, str) else None


def conversation_key(provider: str, source_id: str | None, file: str, ordinal: int) -> str:
    """The id of a conversation; by file and place where the export gives none."""
    return f"{provider}:conversation:{source_id}" if source_id else f"{provider}:conversation:missing:{file}:{ordinal}"


def message_key(provider: str, source_id: str | None, conversation_id: str, local: str) -> str:
    """The id of a message; by conversation and local key where the export gives none."""
    return f"{provider}:message:{source_id}" if source_id else f"{provider}:message:missing:{conversation_id}:{local}"


def canonical_time(value: object) -> str | None:
    """UTC ISO 8601 ending in ``Z`` of an epoch number, numeric string or ISO string; raises on other text."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    if isinstance(value, str):
        value = value.strip()
        if not value:
            return None
        try:
            value = float(value)
        except ValueError:
            moment = datetime.fromisoformat(value.replace("Z", "+00:00"))
            moment = moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment
            return moment.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")
    return datetime.fromtimestamp(value, tz=timezone.utc).isoformat().replace("+00:00", "Z")


def joined_text(blocks: list[dict]) -> str | None:
    """The text blocks of a message, joined by an empty line."""
    return "\n\n".join(b["text"] for b in blocks if b["type"] == "text" and b["text"]) or None


def visible_chain(mapping: dict, current: object) -> list[tuple[str, dict, dict]]:
    """(node id, node, message) from the root to the current node; nodes without a message are left out."""
    chain, seen = [], set()
    while isinstance(current, str) and current not in seen and isinstance(mapping.get(current), dict):
        seen.add(current)
        node = mapping[current]
        if isinstance(node.get("message"), dict):
            chain.append((current, node, node["message"]))
        current = node.get("parent")
    return chain[::-1]


def _first(item: object, names: tuple[str, ...]) -> str | None:
    if isinstance(item, str):
        return item
    return next((v for n in names if isinstance(item, dict) and (v := text_or_none(item.get(n)))), None)


def _block(kind: str, text: object, **more: object) -> dict:
    return {"type": kind, "text": blank_to_none(text), "start_timestamp": None, "stop_timestamp": None, "citations": None} | more


def _ref(kind: str, source_ref: str | None, path: str | None = None) -> dict:
    return {"kind": kind, "path": path, "source_ref": source_ref}


def graph_content(message: dict) -> tuple[list[dict], list[dict]]:
    """(blocks, attachments) of a graph message: its parts in order, then what its metadata attaches."""
    blocks, refs = [], []
    content, extra = message.get("content"), message.get("metadata")
    content = content if isinstance(content, dict) else {}
    outer = text_or_none(content.get("content_type")) or "unknown"
    parts = content.get("parts")
    for k, part in enumerate(parts if isinstance(parts, list) else []):
        if isinstance(part, str):
            blocks.append(_block("text", part))
        elif isinstance(part, dict):
            kind = text_or_none(part.get("content_type")) or outer
            blocks.append(_block(kind, part.get("text")))
            pointer, file_id = text_or_none(part.get("asset_pointer")), text_or_none(part.get("file_id"))
            if pointer:
                head = "file-service://"
                refs.append(_ref(kind, pointer, pointer.removeprefix(head) if pointer.startswith(head) else None))
            elif file_id or part:
                refs.append(_ref(kind, file_id or f"part-{k}"))
    listed = extra.get("attachments") if isinstance(extra, dict) else None
    for item in listed if isinstance(listed, list) else []:
        path = _first(item, ("name", "file_name")) if isinstance(item, dict) else None
        refs.append(_ref("attachment", _first(item, ("id", "file_id", "asset_pointer", "name")), path))
    return blocks, refs


def _message(**known: object) -> dict:
    names = ("parent_message_id", "author_role", "author_name", "sender")
    return dict.fromkeys(names) | known


def map_graph(raw: dict, file: str, ordinal: int, root: str) -> tuple[dict, list[dict]]:
    """The canonical conversation and messages of a graph conversation."""
    source_id = text_or_none(raw.get("conversation_id") or raw.get("id"))
    cid = conversation_key(GRAPH, source_id, file, ordinal)
    mapping = raw.get("mapping") if isinstance(raw.get("mapping"), dict) else {}
    rows, ids = [], {}
    for k, (node_id, node, m) in enumerate(visible_chain(mapping, raw.get("current_node"))):
        author = m.get("author") if isinstance(m.get("author"), dict) else {}
        content = m.get("content") if isinstance(m.get("content"), dict) else {}
        blocks, refs = graph_content(m)
        own = text_or_none(m.get("id")) or node_id
        parent = node.get("parent")
        mid = message_key(GRAPH, own, cid, node_id)
        rows.append(
            _message(
                message_id=mid, conversation_id=cid, provider=GRAPH, source_message_id=own, parent_message_id=ids.get(parent) if isinstance(parent, str) else None, sequence_index=k, content_blocks=blocks,
                source_artifact={"conversation_file": file, "raw_message_path": f"mapping.{node_id}.message"},
                source_metadata={"content_type": text_or_none(content.get("content_type")), "channel": text_or_none(m.get("channel")), "status": text_or_none(m.get("status")), "flags": None},
                author_role=text_or_none(author.get("role")), author_name=blank_to_none(author.get("name")), created_at=canonical_time(m.get("create_time")), updated_at=canonical_time(m.get("update_time")), text=joined_text(blocks), attachments=refs,
            )
        )
        ids[node_id] = mid
    names = ("is_archived", "is_starred", "is_read_only", "is_do_not_remember", "is_study_mode")
    flags = {n: raw[n] if isinstance(raw.get(n), bool) else None for n in names}
    meta = {"conversation_origin": text_or_none(raw.get("conversation_origin")), **flags, "default_model_slug": text_or_none(raw.get("default_model_slug")), "account_uuid": None}
    conversation = {
        "conversation_id": cid, "provider": GRAPH, "source_conversation_id": source_id or "", "title": blank_to_none(raw.get("title")), "summary": None, "created_at": canonical_time(raw.get("create_time")), "updated_at": canonical_time(raw.get("update_time")), "message_count": len(rows),
        "source_artifact": {"root": root, "conversation_file": file, "sidecar_files": []}, "source_metadata": meta,
        "participant_summary": {"roles": sorted({r["author_role"] for r in rows if r["author_role"]}), "authors": sorted({r["author_name"] for r in rows if r["author_name"]})},
    }
    return conversation, rows


def map_flat(raw: dict, file: str, ordinal: int, root: str) -> tuple[dict, list[dict]]:
    """The canonical conversation and messages of a flat conversation. Its count takes in entries that are skipped."""
    source_id = text_or_none(raw.get("uuid"))
    cid = conversation_key(FLAT, source_id, file, ordinal)
    listed = raw.get("chat_messages") if isinstance(raw.get("chat_messages"), list) else []
    rows = []
    for k, m in enumerate(listed):
        if not isinstance(m, dict):
            continue
        content = [b for b in m["content"] if isinstance(b, dict)] if isinstance(m.get("content"), list) else []
        blocks = [
            _block(
                text_or_none(b.get("type")) or "unknown", b.get("text"), start_timestamp=canonical_time(b.get("start_timestamp")), stop_timestamp=canonical_time(b.get("stop_timestamp")),
                citations=json.dumps(b["citations"], sort_keys=True) if isinstance(b.get("citations"), list) else None,
            )
            for b in content
        ]
        flags = [f for b in content if b.get("flags") is not None for f in (b["flags"] if isinstance(b["flags"], list) else [b["flags"]])]
        refs = [_ref(key[:-1], _first(i, ("uuid", "id", "file_id", "name", "file_name"))) for key in ("attachments", "files") if isinstance(m.get(key), list) for i in m[key]]
        own, sender = text_or_none(m.get("uuid")), text_or_none(m.get("sender"))
        rows.append(
            _message(
                message_id=message_key(FLAT, own, cid, f"index-{k}"), conversation_id=cid, provider=FLAT, source_message_id=own or "", sequence_index=k, content_blocks=blocks,
                source_artifact={"conversation_file": file, "raw_message_path": f"chat_messages[{k}]"}, source_metadata={"content_type": None, "channel": None, "status": None, "flags": json.dumps(flags, sort_keys=True) if flags else None},
                author_role={"human": "user", "assistant": "assistant"}.get(sender), sender=sender, created_at=canonical_time(m.get("created_at")), updated_at=canonical_time(m.get("updated_at")), text=joined_text(blocks), attachments=refs,
            )
        )
    account = raw.get("account") if isinstance(raw.get("account"), dict) else {}
    empty = dict.fromkeys(("conversation_origin", "is_archived", "is_starred", "is_read_only", "is_do_not_remember", "is_study_mode", "default_model_slug"))
    conversation = {
        "conversation_id": cid, "provider": FLAT, "source_conversation_id": source_id or "", "title": blank_to_none(raw.get("name")), "summary": blank_to_none(raw.get("summary")), "created_at": canonical_time(raw.get("created_at")), "updated_at": canonical_time(raw.get("updated_at")),
        "message_count": len(listed), "source_artifact": {"root": root, "conversation_file": file, "sidecar_files": []}, "source_metadata": empty | {"account_uuid": text_or_none(account.get("uuid"))},
        "participant_summary": {"roles": sorted({s for m in listed if isinstance(m, dict) and (s := text_or_none(m.get("sender")))}), "authors": []},
    }
    return conversation, rows


def _split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for path, text in zip(pdf["path"], pdf["value"]):
            items = json.loads(text)
            if not isinstance(items, list):
                raise ValueError(f"{path} must hold a JSON array")
            rows = [(path, k, json.dumps(x)) for k, x in enumerate(items) if isinstance(x, dict)]
            for a in range(0, len(rows), 500):
                yield pd.DataFrame(rows[a : a + 500], columns=["path", "ordinal", "raw"])


def _mapped(mapper: Callable, root: str, which: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, ordinal, raw in zip(pdf["path"], pdf["ordinal"], pdf["raw"]):
                pair = mapper(json.loads(raw), PurePosixPath(path).name, int(ordinal), root)
                out += [json.dumps(pair[0])] if which == 0 else [json.dumps(m) for m in pair[1]]
            yield pd.DataFrame({"row": out}, columns=["row"])

    return run


def _tables(spark: SparkSession, paths: list[str], mapper: Callable, root: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    raw = ship_sources(files).mapInPandas(_split, "path string, ordinal long, raw string").repartition("path", "ordinal")
    tables = []
    for which, schema in ((0, S.CONVERSATION), (1, S.MESSAGE)):
        rows = raw.mapInPandas(_mapped(mapper, root, which), "row string")
        tables.append(rows.select(F.from_json("row", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"))
    return tables[0], tables[1]


def list_files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Paths that match, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in (found or []))


def read_graph_export(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) of the shards ``conversations-*.json`` below ``root``; fails where there is none."""
    paths = list_files(spark, root, "conversations-*.json")
    if not paths:
        raise FileNotFoundError(f"no conversations-*.json in {root}")
    return _tables(spark, paths, map_graph, PurePosixPath(root).name)


def read_flat_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) of a ``conversations.json``; files beside it are never read."""
    return _tables(spark, [path], map_flat, PurePosixPath(path).parent.name)
