"""Runs: immutable directories of normalized conversations and messages with a manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as T
from ..session import ship_sources
from . import exports as X


@dataclass
class Run:
    """A loaded run. ``messages`` keeps one row of an id, the last; ``all_messages`` keeps all."""

    run_id: str
    conversations: DataFrame
    messages: DataFrame
    all_messages: DataFrame
    manifest: dict
    path: str = ""


def _sorted(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) for c in sorted(df.columns)])


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line with sorted keys and ASCII escapes, nulls kept."""
    escaped = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    ship_sources(df).select(escaped.alias("value")).mapInPandas(_ascii, "value string").write.mode("errorifexists").text(path)


def _ascii(frames):
    for pdf in frames:
        yield pdf.assign(value=[json.dumps(json.loads(v), ensure_ascii=True, sort_keys=True) for v in pdf["value"]])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of a JSONL file; blank lines are skipped and a malformed one fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


_NOTES = {
    X.GRAPH: ["Only the chain of the current node is kept.", "Branches and nodes without a message are left out."],
    X.FLAT: ["Sidecar files are not read."],
}


def write_run(spark: SparkSession, out_root: str, graph_root: str | None = None, flat_path: str | None = None, run_id: str | None = None, created_at: str | None = None, jsonl: bool = False) -> str:
    """Normalize one export or both into ``out_root/run_id``, which must not exist; returns the run's path."""
    sources = {X.GRAPH: graph_root, X.FLAT: flat_path and str(Path(flat_path).parent)}
    sources = {k: v for k, v in sources.items() if v}
    if not sources:
        raise ValueError("an export is needed")
    created_at = created_at or datetime.now(timezone.utc).isoformat(timespec="seconds").replace("+00:00", "Z")
    run_id = run_id or f"run-{created_at.replace(':', '').replace('-', '')}"
    path = Path(out_root) / run_id
    path.mkdir(parents=True, exist_ok=False)
    tables = []
    if graph_root:
        tables.append(X.read_graph_export(spark, graph_root))
    if flat_path:
        tables.append(X.read_flat_export(spark, flat_path))
    conversations, messages = tables[0]
    for c, m in tables[1:]:
        conversations, messages = conversations.unionByName(c), messages.unionByName(m)
    conversations = conversations.repartitionByRange("provider", "conversation_id").sortWithinPartitions("provider", "conversation_id")
    keys = ["provider", "conversation_id", "sequence_index", "message_id"]
    messages = messages.repartitionByRange(*keys).sortWithinPartitions(*keys)
    conversations.write.mode("errorifexists").parquet(str(path / "conversations"))
    messages.write.mode("errorifexists").parquet(str(path / "messages"))
    conversations, messages = (spark.read.parquet(str(path / t)) for t in ("conversations", "messages"))
    if jsonl:
        write_jsonl(conversations, str(path / "conversations.jsonl"))
        write_jsonl(messages, str(path / "messages.jsonl"))
    counts = {p: {"conversation_count": 0, "message_count": 0} for p in sources}
    for name, df in (("conversation_count", conversations), ("message_count", messages)):
        for r in df.groupBy("provider").count().collect():
            counts[r["provider"]][name] = r["count"]
    manifest = {
        "run_id": run_id, "created_at": created_at, "providers_present": sorted(sources), "source_roots": sources if len(sources) > 1 else list(sources.values()), "counts_by_provider": counts,
        **{n: sum(c[n] for c in counts.values()) for n in ("conversation_count", "message_count")}, "notes": [n for p in sorted(sources) for n in _NOTES[p]],
    }
    (path / "manifest.json").write_text(json.dumps(manifest, ensure_ascii=True, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return str(path)


def load_run(spark: SparkSession, path: str) -> Run:
    """A run as written, from Parquet or else JSONL; rows without their ids are left out."""
    root = Path(path)
    manifest_path = root / "manifest.json"
    if not manifest_path.is_file():
        raise FileNotFoundError(f"no manifest in {path}")
    manifest = json.loads(manifest_path.read_text(encoding="utf-8"))
    tables = []
    for name, schema in (("conversations", S.CONVERSATION), ("messages", S.MESSAGE)):
        if (root / name).is_dir():
            tables.append(spark.read.parquet(str(root / name)))
        elif (root / f"{name}.jsonl").exists():
            tables.append(read_jsonl(spark, str(root / f"{name}.jsonl"), schema))
        else:
            raise FileNotFoundError(f"no {name} in {path}")
    named = lambda c: T.blank_to_null(F.col(c)).isNotNull()
    conversations = tables[0].where(named("conversation_id"))
    every = tables[1].where(named("message_id") & named("conversation_id")).withColumn("sequence_index", F.coalesce("sequence_index", F.lit(0)))
    return Run(T_run_id(manifest, root), conversations, last_of_each(every), every, manifest, str(root))


def T_run_id(manifest: dict, root: Path) -> str:
    """The manifest's id, or the directory's name."""
    return (manifest.get("run_id") or "").strip() or root.name


def last_of_each(messages: DataFrame) -> DataFrame:
    """One row of each ``message_id``, the last in reading order."""
    placed = messages.withColumn("__n", F.monotonically_increasing_id())
    last = Window.partitionBy("message_id").orderBy(F.desc("__n"))
    return placed.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__n", "__r")


@dataclass(frozen=True)
class Inventory:
    """What lies in a provider's folder."""

    provider: str
    root: str
    exists: bool
    files: tuple[str, ...]

    @property
    def status(self) -> str:
        return "missing" if not self.exists else "ready" if self.files else "empty"

    @property
    def top_level(self) -> tuple[str, ...]:
        return tuple(sorted({f.split("/")[0] for f in self.files}))


def inventory(root: str, providers: tuple[str, ...] = (X.GRAPH, X.FLAT)) -> list[Inventory]:
    """Files of each provider's folder, hidden ones and those below hidden folders left out."""
    out = []
    for p in providers:
        base = Path(root) / p
        files = sorted(str(f.relative_to(base)) for f in base.rglob("*") if f.is_file() and not any(x.startswith(".") for x in f.relative_to(base).parts)) if base.exists() else []
        out.append(Inventory(p, str(base), base.exists(), tuple(files)))
    return out
