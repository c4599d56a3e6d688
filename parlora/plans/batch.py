"""Evidence, decisions and narratives as tables: many queries in one plan, a group of rows for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import constants as C
from ..functions import local as L
from ..functions import text as T
from ..session import ship_sources, stored
from . import answer as A
from . import evidence as E
from . import narrative as N

_EVIDENCE = "rank int, window_rank int, window_id string, score double, role string, terms array<string>, excerpt string, message_id string, conversation_id string, provider string, title string, created_at string, mode string"


#: Rows of a batch that a Python function returns.
BATCH = 2_000
#: Phases of a query that are described by one task.
BLOCK = 1_000


def streamed(rows: DataFrame, keys: list[str], order: list[str], schema: str, f: Callable[[tuple, Iterator[SimpleNamespace]], Iterable[tuple]]) -> DataFrame:
    """``f(key, rows)`` for each group of ``keys``, its rows in ``order``; its tuples are the columns of ``schema`` after the keys.

    Spark sorts the rows, and they are read as a stream: Python holds a batch of them, and what ``f`` keeps.
    """
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    whole = f"{kinds}, {schema}"
    out = to_arrow_schema(rows.sparkSession.createDataFrame([], whole).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = (SimpleNamespace(**r) for b in batches for at in range(0, b.num_rows, BATCH) for r in b.slice(at, BATCH).to_pylist())
        made = []
        for key, own in groupby(items, lambda r: tuple(getattr(r, k) for k in keys)):
            for r in f(key, own):
                made.append((*key, *r))
                if len(made) >= BATCH:
                    yield batch(made)
                    made = []
        if made:
            yield batch(made)

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), out)], schema=out)

    return ship_sources(rows).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, whole)


def by_query(rows: DataFrame, keys: list[str], schema: str, f: Callable[[list[SimpleNamespace]], Iterable[tuple]]) -> DataFrame:
    """``f`` over the rows of each query by rank, of which there are few."""
    return streamed(rows, keys, ["rank"], schema, lambda _, own: f(list(own)))


def evidence_table(windows: DataFrame, cap: int = C.EVIDENCE_CAP) -> DataFrame:
    """Excerpts of ``windows(query_id, query, rank, result_id, score, messages)``, a row each."""

    def one(ranked: list[SimpleNamespace]) -> Iterable[tuple]:
        shown = [{"rank": w.rank, "result_id": w.result_id, "score": w.score, "messages": w.messages} for w in ranked]
        for i in E.select(shown, ranked[0].query, cap):
            yield i.rank, i.window_rank, i.window_id, i.score, i.role, list(i.terms), i.excerpt, i.message_id, i.conversation_id, i.provider, i.title, i.created_at, i.mode

    return by_query(windows, ["query_id", "query"], _EVIDENCE, one)


def _item(r: SimpleNamespace) -> E.Evidence:
    return E.Evidence(r.rank, r.window_rank, r.window_id, float(r.score), r.role, tuple(r.terms), r.excerpt, r.message_id, r.conversation_id or "", r.provider or "unknown", r.title, r.created_at, r.mode or "relevance")


def decisions_table(evidence: DataFrame, grounding: str = "strict") -> DataFrame:
    """A row for each query of ``evidence``: what qualifies, why, and the status that it allows."""
    schema = "kept array<string>, basis string, reason string, composed boolean, coverage double, window_id string, status string, gaps array<string>"

    def one(ranked: list[SimpleNamespace]) -> Iterable[tuple]:
        query, items = ranked[0].query, tuple(map(_item, ranked))
        kept = E.qualify(query, items, grounding)
        said = A.refine(A.decide(query, kept), len(items), kept, E.rejections(query, items, kept))
        yield [i.message_id for i in kept.items], kept.basis, kept.reason, kept.composed, kept.coverage, kept.window_id, said.status, list(said.gaps)

    return by_query(evidence, ["query_id", "query"], schema, one)


def rejections_table(evidence: DataFrame, grounding: str = "strict") -> DataFrame:
    """A row for each excerpt that isn't used, with the reasons."""

    def one(ranked: list[SimpleNamespace]) -> Iterable[tuple]:
        query, items = ranked[0].query, tuple(map(_item, ranked))
        for r in E.rejections(query, items, E.qualify(query, items, grounding)):
            yield r["message_id"], list(r["missing"]), list(r["reasons"])

    return by_query(evidence, ["query_id", "query"], "message_id string, missing array<string>, reasons array<string>", one)


def _walk(days: int) -> Callable[[tuple, Iterator[SimpleNamespace]], Iterable[tuple]]:
    """The phase of each item of a query, items in time order: the rule of ``narrative.group``, one item at a time."""

    def one(key: tuple, items: Iterator[SimpleNamespace]) -> Iterable[tuple]:
        skip, phase, words, before = {t.lower() for t in L.focus_terms(key[1])}, 0, set(), None
        for r in items:
            own, now = set(r.words) - skip, L.date_of(r.created_at)
            near = phase and (L.days_between(before, now) <= days if before and now else before == now)
            if near and L.jaccard(own, words) >= C.PHASE_COHERENCE:
                words |= own
            else:
                phase, words = phase + 1, own
            before = now
            yield r.rank, phase

    return one


def _placed(evidence: DataFrame, days: int) -> DataFrame:
    """Evidence with ``phase``. Only words, times and ranks pass through the walk along a query, as a stream."""
    keys = ["query_id", "query"]
    at = F.coalesce("created_at", F.lit(""))
    words = F.array_distinct(F.concat(T.content_terms(F.col("excerpt")), T.entity_terms(F.col("excerpt"))))
    narrow = evidence.select(*keys, "rank", "created_at", (at == "").alias("timeless"), at.alias("at"), words.alias("words"))
    phases = streamed(narrow, keys, ["timeless", "at", "rank"], "rank int, phase int", _walk(days))
    a, b = evidence.alias("a"), phases.alias("b")
    same = F.lit(True)
    for k in (*keys, "rank"):
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select("a.*", "b.phase")


def narrative_tables(evidence: DataFrame, days: int = C.PHASE_DAYS, gap_days: int = C.GAP_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phases, transitions, gaps) of the narrative of each query.

    Phases are described in blocks of neighbours, each with the phase that follows it, so a query isn't one task's work.
    """
    keys = ["query_id", "query"]
    evidence = stored(evidence, "evidence")
    first = F.floor((F.col("phase") - 1) / BLOCK)
    twice = F.when((F.col("phase") > 1) & (F.col("phase") % BLOCK == 1 % BLOCK), F.array(first, first - 1)).otherwise(F.array(first))
    placed = _placed(evidence, days).withColumn("block", F.explode(twice)).withColumn("at", F.coalesce("created_at", F.lit(""))).withColumn("timeless", F.col("at") == "")

    def described(schema: str, f: Callable[[int, list[E.Evidence], list[E.Evidence] | None], Iterable[tuple]]) -> DataFrame:
        def one(key: tuple, rows: Iterator[SimpleNamespace]) -> Iterable[tuple]:
            number, left = None, None
            for phase, own in groupby(rows, lambda r: r.phase):
                items = [_item(r) for r in own]
                if left:
                    yield from f(number, left, items)
                number, left = phase, items
            if left and (number - 1) // BLOCK == key[2]:  # else it stands in its own block
                yield from f(number, left, None)

        return streamed(placed, [*keys, "block"], ["phase", "timeless", "at", "rank"], schema, one).drop("block")

    def phase(k: int, own: list[E.Evidence], _) -> Iterable[tuple]:
        p = N.make_phase(own)
        yield k, p.label, p.description, list(p.evidence_ids), p.date_range, p.support

    def turn(k: int, left: list[E.Evidence], right: list[E.Evidence] | None) -> Iterable[tuple]:
        if right:
            t = N.transition(N.make_phase(left), N.make_phase(right), left, right)
            yield k, t.from_phase, t.to_phase, t.description

    def hole(k: int, left: list[E.Evidence], right: list[E.Evidence] | None) -> Iterable[tuple]:
        if right:
            for g in N.gaps([N.make_phase(left), N.make_phase(right)], gap_days):
                yield k, g.description

    phases = described("phase int, label string, description string, evidence_ids array<string>, date_range string, support string", phase)
    turns = described("turn int, from_phase string, to_phase string, description string", turn)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("turn")).alias("gap")
    return phases, turns, described("turn int, description string", hole).select(*keys, number, "description")


def recurring_table(phases: DataFrame) -> DataFrame:
    """(name, occurrence_count, first_seen): entities of two phases or more, over all narratives of ``phases``."""
    names = F.array_distinct(F.transform(T.entity_terms(F.col("description")), T.canonical))
    day = F.when(F.length("date_range") >= 10, F.substring("date_range", 1, 10))
    told = phases.select("query_id", "phase", "evidence_ids", day.alias("day"), F.explode(names).alias("name"))
    # The first phase in order stands for all with the same evidence ids.
    once = told.groupBy("name", "evidence_ids").agg(F.min(F.struct("query_id", "phase", "day")).alias("first"))
    return once.groupBy("name").agg(F.count("*").cast("int").alias("occurrence_count"), F.min("first.day").alias("first_seen")).where("occurrence_count >= 2")
