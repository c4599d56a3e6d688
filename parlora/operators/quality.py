"""Data quality of normalized messages, from two aggregates and a few ordered samples."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_SENDERS = ("unknown", "human", "assistant", "user", "")


def flags(messages: DataFrame) -> DataFrame:
    """Messages with the yes-or-no columns that the report counts."""
    blank = lambda b: T.blank_to_null(b["text"]).isNull()
    blocks = F.coalesce("content_blocks", F.array().cast(messages.schema["content_blocks"].dataType))
    refs = F.coalesce(F.size("attachments"), F.lit(0))
    text_missing = T.blank_to_null(F.col("text")).isNull()
    meaningful = F.exists(blocks, lambda b: ~blank(b))
    role, sender = F.coalesce("author_role", F.lit("unknown")), F.coalesce("sender", F.lit("unknown"))
    return messages.select(
        "*",
        F.coalesce("provider", F.lit("unknown")).alias("q_provider"), role.alias("q_role"),
        (F.greatest(refs, F.lit(0)) > 0).alias("q_attached"),
        F.exists(blocks, lambda b: F.coalesce(b["type"], F.lit("")) != "text").alias("q_non_text"),
        (text_missing & ~meaningful & (refs <= 0)).alias("q_empty"),
        (text_missing & meaningful).alias("q_null_text"),
        (((role == "system") | ~sender.isin(*_SENDERS)) & text_missing & ~meaningful).alias("q_system"),
        (F.size(blocks) == 0).alias("q_no_blocks"),
        F.size(F.filter(blocks, lambda b: F.coalesce(b["type"], F.lit("")) == "")).alias("q_untyped"),
        F.size(F.filter(blocks, blank)).alias("q_textless"),
    )


def distribution(messages: DataFrame) -> DataFrame:
    """(dimension, value, n, empty): counts by provider and by role, and over all, in one pass."""
    marked = flags(messages)
    counted = marked.groupingSets([["q_provider"], ["q_role"], []], "q_provider", "q_role")
    return counted.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("q_empty").alias("empty")).select(
        F.when(F.col("g") == 1, "provider").when(F.col("g") == 2, "author_role").otherwise("all").alias("dimension"), F.coalesce(F.when(F.col("g") == 1, F.col("q_provider")), F.when(F.col("g") == 2, F.col("q_role")), F.lit("")).alias("value"), "n", "empty"
    )


def _samples(marked: DataFrame, which: Column, limit: int) -> list[dict]:
    first = F.get(F.filter(F.transform("content_blocks", lambda b: T.blank_to_null(b["text"])), lambda t: t.isNotNull()), F.lit(0))
    preview = T.cut(F.coalesce(T.blank_to_null(F.col("text")), first), 120)
    rows = marked.where(which).select(F.coalesce("message_id", F.lit("")).alias("message_id"), F.col("q_provider").alias("provider"), preview.alias("snippet"))
    return [r.asDict() for r in rows.orderBy("provider", "message_id").limit(limit).collect()]


def report(messages: DataFrame, path: str = "") -> dict[str, object]:
    """The report as plain values."""
    marked = flags(messages)
    by = {"provider": {}, "author_role": {}, "all": {}}
    for r in distribution(messages).collect():
        by[r["dimension"]][r["value"]] = (r["n"], r["empty"])
    sums = marked.agg(*[F.count_if(c).alias(c) for c in ("q_attached", "q_non_text", "q_null_text", "q_system", "q_no_blocks")], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("q_untyped", "q_textless")]).first()
    total, empty = by["all"].get("", (0, 0))
    share = lambda n: n / total * 100 if total else 0.0
    column = lambda d, k: {v: x[k] for v, x in sorted(by[d].items()) if k == 0 or x[k]}
    bad = marked.where("q_untyped > 0 or q_textless > 0").withColumn("n", F.monotonically_increasing_id()).orderBy("n").limit(3)
    examples = []
    for r in bad.select("message_id", "content_blocks").collect():
        for b in r["content_blocks"]:
            issues = ["missing_type"] * (not b["type"]) + ["missing_or_empty_text"] * (not (b["text"] or "").strip())
            examples += [{"message_id": r["message_id"], "issue": i, "block": b.asDict()} for i in issues]
    return {
        "messages_path": path, "total_messages": total,
        "distribution_summary": {"total_messages": total, "messages_by_provider": column("provider", 0), "messages_by_author_role": column("author_role", 0), "messages_with_attachments": sums["q_attached"], "messages_with_non_text_content_blocks": sums["q_non_text"]},
        "empty_messages": {"count": empty, "percentage": share(empty), "by_provider": column("provider", 1), "by_author_role": column("author_role", 1), "samples": _samples(marked, F.col("q_empty"), 5)},
        "null_text_but_nonempty_content_blocks": {"count": sums["q_null_text"], "percentage": share(sums["q_null_text"]), "samples": _samples(marked, F.col("q_null_text"), 3)},
        "system_metadata_only_messages": {"count": sums["q_system"], "percentage": share(sums["q_system"]), "recommendation": "candidate_for_filtering" if sums["q_system"] else "keep", "samples": _samples(marked, F.col("q_system"), 5)},
        "content_blocks_integrity": {"messages_with_empty_content_blocks": sums["q_no_blocks"], "blocks_missing_type": sums["q_untyped"], "blocks_missing_text": sums["q_textless"], "messages_with_non_text_content_blocks": sums["q_non_text"], "malformed_examples": examples[:3]},
    }


def write_report(found: dict[str, object], path: str) -> None:
    """Stable JSON."""
    Path(path).write_text(json.dumps(found, ensure_ascii=True, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def render(found: dict[str, object]) -> str:
    """The report as text: every section's plain values, then its samples."""
    lines = ["Message Quality Report", f"messages_path: {found['messages_path']}"]
    for name, part in found.items():
        if not isinstance(part, dict):
            continue
        lines += ["", name.replace("_", " ").title()]
        for key, value in part.items():
            if isinstance(value, dict):
                lines += [f"  {key}:", *(f"    - {k}: {v}" for k, v in value.items())]
            elif isinstance(value, list):
                lines += [f"  {key}:", *(f"    - {', '.join(f'{k}={v}' for k, v in row.items() if k != 'block')}" for row in value)]
            else:
                lines.append(f"  {key}: {value:.2f}" if isinstance(value, float) else f"  {key}: {value}")
    return "\n".join(lines)
