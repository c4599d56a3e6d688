"""Questions to a run: search, answers, narratives, patterns, benchmarks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import explain as X
from ..operators import index as I
from ..operators import retrieval as R
from ..operators import windows as W
from ..sources.runs import Run
from . import answer as A
from . import evaluate as V
from . import evidence as E
from . import narrative as N
from . import patterns as P
from ..session import ship_sources
from . import router


class Engine:
    """A run with its lexical index, which is stored beside the run and built at first use."""

    def __init__(self, spark: SparkSession, run: Run, index_path: str | None = None) -> None:
        self.spark, self.run = spark, run
        if index_path and Path(index_path).is_dir():
            self.index = I.Index.load(spark, index_path)
        else:
            self.index = I.build_index(run.messages)
            if index_path:
                self.index.save(index_path)
                self.index = I.Index.load(spark, index_path)

    def candidates(self, parsed: DataFrame, channel: str = "bm25", filters: R.Filters | None = None, limit: int = 8, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, model: str | None = None) -> DataFrame:
        """Candidates of parsed queries by channel."""
        if channel not in R.CHANNELS:
            raise ValueError(f"no channel {channel!r}")
        lexical = R.lexical_candidates(self.index, self.run.messages, parsed, filters, self.run.conversations)
        if channel == "bm25":
            return lexical
        if vectors is None or query_vectors is None or model is None:
            raise ValueError(f"the channel {channel} needs vectors, query_vectors and model")
        semantic = R.semantic_candidates(vectors, self.run.messages, query_vectors, model, limit, filters)
        return semantic if channel == "semantic" else R.hybrid_merge(lexical, semantic)

    def search(self, queries: DataFrame, mode: str = "relevance", limit: int = 8, radius: int = C.WINDOW_RADIUS, **channel) -> DataFrame:
        """Context windows of ``queries(query_id, query)``, with ``result_rank``, ``match_basis`` and ``provenance``."""
        if mode not in R.WINDOW_MODES:
            raise ValueError(f"no window mode {mode!r}")
        parsed = R.parse_queries(queries)
        ranked = R.apply_mode(self.candidates(parsed, limit=limit, **channel), mode)
        kept = X.explained(W.greedy_accept(ranked, self.run.messages, limit, radius), parsed, self.index, mode, channel.get("channel", "bm25"), channel.get("filters"))
        windows = W.context_windows(kept, self.run.messages, radius, self.run.run_id, self.run.conversations)
        return X.with_provenance(windows, self.run.conversations, self.run.path)

    def timeline(self, queries: DataFrame, limit: int = 8, filters: R.Filters | None = None) -> DataFrame:
        """Matching messages of ``queries``, oldest first."""
        return W.timeline(self.candidates(R.parse_queries(queries), "bm25", filters), limit)

    def windows(self, query: str, mode: str = "relevance", limit: int = 8, **channel) -> list[dict]:
        """The windows of one query as plain values, by rank."""
        queries = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        rows = self.search(queries, mode, limit, **channel).orderBy("result_rank").collect()
        return [{**r.asDict(), "rank": r["result_rank"], "mode": mode, "messages": [m.asDict(True) for m in r["messages"]]} for r in rows]

    def answer(self, query: str, mode: str = "relevance", limit: int = 8, cap: int = C.EVIDENCE_CAP, grounding: str = "strict", filters: R.Filters | None = None, writer: A.Writer | None = None, hybrid: bool = False) -> A.Answer:
        """An answer from lexical search."""
        if mode not in ("relevance", "newest", "oldest"):
            raise ValueError(f"answers have no mode {mode!r}")
        return A.answer(query, self.windows(query, mode, limit, filters=filters), cap, grounding, writer, hybrid)

    def narrative(self, query: str, mode: str = "relevance", limit: int = 10, cap: int = 10, days: int = C.PHASE_DAYS, gap_days: int = C.GAP_DAYS, **channel) -> N.Narrative:
        """The narrative of a query's evidence; qualification isn't applied."""
        return N.build(query, E.select(self.windows(query, mode, limit, **channel), query, cap), days, gap_days)

    def patterns(self, queries: list[str], **options) -> tuple[P.Report, list[N.Narrative]]:
        """Patterns over the narratives of several queries."""
        found = [self.narrative(q, **options) for q in queries]
        return P.report(found), found

    def ask(self, question: str, queries: list[str], **options) -> str:
        """A routed answer over the patterns of several queries."""
        report, found = self.patterns(queries, **options)
        return router.route(question, report, found)

    def benchmark(self, cases: list[V.Case], path: str = "") -> tuple[V.Summary, list[V.CaseResult]]:
        """Answers of a bank of queries, judged."""
        results = [V.judge(c, self.answer(c.query, c.retrieval_mode)) for c in cases]
        return V.summarize(results, self.run.run_id, path), results


def debug_windows(query: str, windows: list[dict], cap: int = C.EVIDENCE_CAP) -> list[E.WindowView]:
    """How each window of a query fares under both ways of grounding."""
    from ..functions.local import focus_terms

    chosen, focus = E.select(windows, query, cap), focus_terms(query)
    out = []
    for w in windows:
        own = tuple(i for i in chosen if i.window_rank == w["rank"])
        none = E.WindowView(w.get("result_id"), w["rank"], False, False, failures=("no_direct_lexical_matches", "no_window_level_composed_support"))
        out.append(E.view_window(own, focus) if own else none)
    return out


def answers_table(engine: Engine, queries: DataFrame, limit: int = 8, cap: int = C.EVIDENCE_CAP, grounding: str = "strict") -> DataFrame:
    """(query_id, status, answer): answers of many queries in one plan, each query's few windows on one worker."""
    import pandas as pd

    found = engine.search(queries, "relevance", limit)
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("result_rank", "score", "result_id", "conversation_id", "provider", "conversation_title", F.to_json("messages").alias("messages")))).alias("w"))
    joined = queries.join(rows, "query_id", "left")

    def run(frames):
        import json

        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                listed = [] if r.w is None else r.w
                windows = [{**dict(w), "rank": w["result_rank"], "messages": json.loads(w["messages"])} for w in listed]
                a = A.answer(r.query, windows, cap, grounding)
                out.append((r.query_id, a.status, a.text))
            yield pd.DataFrame(out, columns=["query_id", "status", "answer"])

    return ship_sources(joined).select("query_id", "query", "w").mapInPandas(run, "query_id long, status string, answer string")
