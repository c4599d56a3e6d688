"""Command line: inspect, normalize, analyze, build-embeddings, retrieve, answer, narrative, patterns, eval."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path

from .functions.local import cut
from .operators import embeddings as B
from .operators import quality as Q
from .operators import retrieval as R
from .operators.index import with_positions
from .plans import evaluate as V
from .plans import narrative as N
from .plans import patterns as P
from .plans import router
from .plans.api import Engine, debug_windows
from .session import session
from .sources import runs


def _client(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _save(path: str | None, text: str) -> None:
    if path:
        Path(path).write_text(text, encoding="utf-8")


def _engine(a) -> Engine:
    spark = session()
    return Engine(spark, runs.load_run(spark, a.run), f"{a.run}/index" if a.index else None)


def _filters(a) -> R.Filters:
    return R.Filters(a.provider, a.conversation_id, a.author_role, a.date_from, a.date_to)


def inspect(a) -> None:
    for p in runs.inventory(a.root):
        print(f"{p.provider}: {p.status}, {len(p.files)} file(s)", *(f"  {t}" for t in p.top_level), sep="\n")


def normalize(a) -> None:
    print(runs.write_run(session(), a.out, a.graph_root, a.flat_path, a.run_id, a.created_at, a.jsonl))


def analyze(a) -> None:
    found = Q.report(runs.load_run(session(), a.run).all_messages, f"{a.run}/messages")
    print(Q.render(found))
    if a.json:
        Q.write_report(found, a.json)


def build_embeddings(a) -> None:
    engine = _engine(a)
    texts = engine.index.docs.select("message_id", "searchable")
    messages = with_positions(engine.run.messages).join(texts, "message_id")
    chosen = B.subset(B.targeted(messages, tuple(a.conversation), tuple(a.message)), a.offset, a.limit, a.sample, a.seed)
    B.replace_artifact(B.embed(chosen, _client(a.client), a.model, engine.run.run_id), f"{a.run}/embeddings")
    B.reason_counts(messages).orderBy("reason").show()


def retrieve(a) -> None:
    engine = _engine(a)
    channel = {"channel": a.channel, "filters": _filters(a)}
    if a.channel != "bm25":
        spark = engine.spark
        vector = _client(a.client)([a.query], a.model)[0]
        channel |= {"vectors": B.read_embeddings(spark, f"{a.run}/embeddings"), "model": a.model, "query_vectors": spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, vector array<double>")}
    if a.mode == "timeline":
        if a.channel != "bm25":
            raise ValueError("a timeline is lexical")
        queries = engine.spark.createDataFrame([(0, a.query)], "query_id long, query string")
        for r in engine.timeline(queries, a.limit, _filters(a)).orderBy("rank").collect():
            print(f"{r['rank']}. {r['created_at'] or 'undated'} {r['author_role']} {r['message_id']}: {r['excerpt']}")
        return
    for w in engine.windows(a.query, a.mode, a.limit, **channel):
        print(f"{w['rank']}. {w['score']:.6f} {w['result_id']} {w['conversation_title'] or ''}")
        for m in w["messages"]:
            print(f"   [{m['author_role']}] {cut(m['text'] or '', 120)}")


def answer(a) -> None:
    engine = _engine(a)
    found = engine.answer(a.query, a.mode, a.limit, a.max_evidence, a.grounding, _filters(a), _client(a.writer) if a.writer else None, a.hybrid)
    print(found.render())
    if a.debug:
        for v in debug_windows(a.query, engine.windows(a.query, a.mode, a.limit, filters=_filters(a)), a.max_evidence):
            print({k: x for k, x in asdict(v).items() if k != "contributors"})
    _save(a.json, found.to_json())


def narrative(a) -> None:
    n = _engine(a).narrative(a.query, a.mode, a.limit, a.max_evidence, filters=_filters(a))
    print(N.render(n, a.debug))
    _save(a.json, n.to_json())


def patterns(a) -> None:
    report, found = _engine(a).patterns(a.query, limit=a.limit)
    print(router.route(a.ask, report, found) if a.ask else P.render(report))
    _save(a.json, report.to_json())


def evaluate(a) -> None:
    summary, results = _engine(a).benchmark(V.load_bank(a.bench), a.bench)
    print(V.render(summary, results, a.fail_only))
    _save(a.json, V.report_json(summary, results))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="parlora", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable, on_run: bool = True, search: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(function=run)
        if on_run:
            p.add_argument("--run", required=True)
            p.add_argument("--json")
            p.add_argument("--index", action="store_true", help="keep the index beside the run")
        if search:
            p.add_argument("query")
            p.add_argument("--mode", default="relevance")
            p.add_argument("--limit", type=int, default=8)
            p.add_argument("--max-evidence", type=int, default=5)
            p.add_argument("--debug", action="store_true")
            for f in ("provider", "conversation-id", "author-role", "date-from", "date-to"):
                p.add_argument(f"--{f}")
        return p

    add("inspect", inspect, False).add_argument("root")
    p = add("normalize", normalize, False)
    for f in ("graph-root", "flat-path", "run-id", "created-at"):
        p.add_argument(f"--{f}")
    p.add_argument("--out", required=True)
    p.add_argument("--jsonl", action="store_true")
    add("analyze", analyze)
    p = add("build-embeddings", build_embeddings)
    p.add_argument("--client", required=True, help="module:function(texts, model)")
    p.add_argument("--model", required=True)
    for f, default in (("offset", 0), ("limit", None), ("sample", None), ("seed", 0)):
        p.add_argument(f"--{f}", type=int, default=default)
    p.add_argument("--conversation", action="append", default=[])
    p.add_argument("--message", action="append", default=[])
    p = add("retrieve", retrieve, search=True)
    p.add_argument("--channel", default="bm25", choices=R.CHANNELS)
    p.add_argument("--client")
    p.add_argument("--model")
    p = add("answer", answer, search=True)
    p.add_argument("--grounding", default="strict")
    p.add_argument("--writer", help="module:function(instructions, prompt)")
    p.add_argument("--hybrid", action="store_true")
    add("narrative", narrative, search=True)
    p = add("patterns", patterns)
    p.add_argument("--query", action="append", required=True)
    p.add_argument("--ask")
    p.add_argument("--limit", type=int, default=10)
    p = add("eval", evaluate)
    p.add_argument("--bench", required=True)
    p.add_argument("--fail-only", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    """0, or 2 on an error that the user can mend."""
    a = parser().parse_args(argv)
    try:
        a.function(a)
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
