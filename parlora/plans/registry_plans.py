"""Queries over the table forms of evidence, decisions and narratives, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import local as L
from ..operators import embeddings as V
from ..operators import explain as X
from ..operators import retrieval as R
from . import batch as B
from .registry import _ENT_SQL, _EXCERPT_SQL, _TERM_SQL, M_SQL, SEARCH, TERMS, VOICE_SQL, _excerpt, _index, _query, bm25_sql, messages

ASKED = "what did dans do about the mentle"
TIED = "the dans's mentle"
FOCUS = L.focus_terms(ASKED)
_CUES = (sorted(C.POSITIVE_CUES)[0], sorted(C.NEGATIVE_CUES)[0], sorted(C.SPECULATION_CUES)[0], *FOCUS, "")


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _windows(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Each conversation as a query's result: windows of three turns, each text led by two words of a fixed list."""
    raw = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    cues = F.array(*map(F.lit, _CUES))
    cue = lambda k: F.element_at(cues, (F.pmod(F.col("conv_id") * k + F.col("turn") * 5, F.lit(len(_CUES))) + 1).cast("int"))
    message = F.struct(F.concat(F.lit("c"), "conv_id", F.lit(":"), F.lpad(F.col("turn").cast("string"), 3, "0")).alias("message_id"), F.col("role").alias("author_role"), F.concat_ws(" ", cue(3), cue(4), "text").alias("text"))
    rows = raw.select("conv_id", (F.floor(F.col("turn") / 3) + 1).cast("int").alias("rank"), F.struct("turn", message.alias("m")).alias("x"))
    windows = rows.groupBy(F.col("conv_id").alias("query_id"), "rank").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]).alias("messages"))
    score = F.pmod(F.col("query_id") * 7 + F.col("rank") * 13, F.lit(20)) / 10
    return windows.select("query_id", F.lit(query).alias("query"), "rank", F.concat(F.lit("w"), "rank").alias("result_id"), score.alias("score"), "messages")


def _cue_sql(k: int) -> str:
    return f"{_list(_CUES)}[CAST((conv_id * {k} + turn * 5) % {len(_CUES)} + 1 AS BIGINT)]"


def _items_sql(focus) -> str:
    """CTEs that end in ``item``, the selected evidence."""
    return f"""WITH said AS (SELECT conv_id, turn, role, {_cue_sql(3)} || ' ' || {_cue_sql(4)} || ' ' || text AS text FROM conversations),
x AS (SELECT conv_id, turn, CAST(turn // 3 + 1 AS INTEGER) AS wr, role, 'c' || conv_id || ':' || lpad(CAST(turn AS VARCHAR), 3, '0') AS message_id, {_EXCERPT_SQL} AS excerpt,
  CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS weight FROM said),
f AS (SELECT *, regexp_extract_all(lower(excerpt), '[a-z0-9]+') AS toks FROM x),
g AS (SELECT *, list_filter({_list(focus)}, lambda t: list_contains(toks, t)) AS terms, list_has_any(toks, {_list(sorted(C.SPECULATION_CUES))}) AS guess FROM f),
top AS (SELECT conv_id, wr, min(turn) AS a, arg_min(role, turn) AS lead FROM g WHERE len(terms) > 0 GROUP BY ALL),
keyed AS (SELECT g.*, CASE WHEN turn = a THEN -1 WHEN len(terms) > 0 THEN 0 ELSE 1 END AS k1, CASE WHEN turn = a THEN weight WHEN len(terms) > 0 THEN abs(turn - a) ELSE abs(turn - a) + weight END AS k2
  FROM g JOIN top USING (conv_id, wr) WHERE excerpt <> '' AND (len(terms) > 0 OR role = lead)),
two AS (SELECT *, row_number() OVER (PARTITION BY conv_id, wr ORDER BY k1, k2, message_id) AS r FROM keyed QUALIFY r <= {C.EVIDENCE_PER_WINDOW}),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY wr, r) AS n FROM two),
item AS (SELECT *, CAST(n AS INTEGER) AS rank, ((conv_id * 7 + wr * 13) % 20) / 10 AS score
  FROM (SELECT *, coalesce(bool_or(n >= {C.EVIDENCE_CAP} AND r < {C.EVIDENCE_PER_WINDOW}) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM num) WHERE NOT over)"""


@_query(_items_sql(FOCUS) + " SELECT conv_id AS query_id, rank, wr AS window_rank, message_id, array_to_string(terms, ' ') AS terms, excerpt, round(score, 6) AS score FROM item")
def evidence_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.evidence_table(_windows(spark, sf_dir, ASKED))
    return rows.select("query_id", "rank", "window_rank", "message_id", F.array_join("terms", " ").alias("terms"), "excerpt", F.round("score", 6).alias("score"))


def _decided_sql(query: str, memory: bool) -> str:
    """CTEs that end in ``outcome``, one row a query, and ``used``, the excerpts that it keeps."""
    focus = L.focus_terms(query)
    n, tied = len(focus), "'s " in query
    whole = f"len(terms) = {n}"
    share = lambda c, of="true": f"len(list_distinct(flatten(list({c}) FILTER ({of})))) / {n}"
    return f"""{_items_sql(focus)},
it AS (SELECT *, EXISTS (SELECT 1 FROM item p WHERE p.conv_id = i.conv_id AND p.message_id <> i.message_id AND p.wr = i.wr AND p.role <> 'assistant' AND NOT p.guess AND list_has_all(p.terms, i.terms)) AS grounded FROM item i),
q AS (SELECT *, len(terms) > 0 AND (role <> 'assistant' OR (NOT guess AND grounded)) AS fit FROM it),
seen AS (SELECT conv_id, wr, coalesce(bool_or(fit AND {whole}), false) AS strict, count(*) FILTER (given) AS givers, count(*) FILTER (given AND role = 'user') AS users,
    coalesce({share("terms", "given")}, 0) AS share, coalesce({share("terms", "given AND role = 'user'")}, 0) AS own
  FROM (SELECT *, score >= {C.MIN_SUPPORT} AND len(terms) > 0 AND NOT (role = 'assistant' AND guess) AS given FROM q) GROUP BY ALL),
composed AS (SELECT conv_id, min(wr) AS cw FROM seen WHERE {'true' if memory else 'false'} AND NOT strict AND share >= {C.COMPOSED_COVERAGE} AND own >= {C.COMPOSED_COVERAGE} AND users > 0 AND givers >= 2 GROUP BY ALL),
state AS (SELECT conv_id, any_value(cw) AS cw, bool_or(fit) AS any_fit, bool_or(fit AND {whole}) AS one FROM q LEFT JOIN composed USING (conv_id) GROUP BY ALL),
way AS (SELECT conv_id, cw, CASE WHEN one THEN 'single_excerpt_support' WHEN cw IS NOT NULL THEN 'window_composed_support' WHEN {str(tied).lower()} THEN 'combined_concept_not_supported'
    WHEN any_fit THEN 'strict_partial_support' ELSE 'no_qualified_evidence' END AS reason FROM state),
used AS (SELECT q.*, reason, cw FROM q JOIN way USING (conv_id) WHERE CASE reason WHEN 'window_composed_support' THEN wr = cw AND score >= {C.MIN_SUPPORT} AND len(terms) > 0 AND NOT (role = 'assistant' AND guess)
    WHEN 'single_excerpt_support' THEN fit WHEN 'strict_partial_support' THEN fit ELSE false END),
firm AS (SELECT conv_id, count(*) AS n, {share("terms")} AS covered, bool_or({whole}) AS one, bool_or(list_has_any(toks, {_list(sorted(C.POSITIVE_CUES))})) AND bool_or(list_has_any(toks, {_list(sorted(C.NEGATIVE_CUES))})) AS clash
  FROM used WHERE score >= {C.MIN_SUPPORT} GROUP BY ALL),
kept AS (SELECT conv_id, string_agg(message_id, ' ' ORDER BY len(terms) DESC, role = 'assistant', score DESC, rank) AS kept, {share("terms")} AS coverage, count(DISTINCT wr) AS nw, min(wr) AS w FROM used GROUP BY ALL),
outcome AS (SELECT conv_id, reason, coalesce(k.kept, '') AS kept, round(coalesce(k.coverage, 0), 6) AS coverage, reason = 'window_composed_support' AS composed, CASE WHEN nw = 1 THEN 'w' || w END AS window_id,
  CASE WHEN k.kept IS NULL OR f.n IS NULL THEN 'insufficient_evidence' WHEN clash THEN 'ambiguous' WHEN reason = 'window_composed_support' THEN 'partially_supported' WHEN f.one THEN 'supported'
    WHEN {str(tied).lower()} THEN 'insufficient_evidence' ELSE 'partially_supported' END AS status,
  CASE WHEN k.kept IS NULL OR f.n IS NULL THEN 1 WHEN clash THEN 0 WHEN reason = 'window_composed_support' THEN 1 WHEN f.one THEN 0 WHEN {str(tied).lower()} THEN 1
    ELSE greatest(1, (covered < 1)::INT + (f.n = 1)::INT) END AS n_gaps
  FROM way LEFT JOIN kept k USING (conv_id) LEFT JOIN firm f USING (conv_id))"""


_OUTCOME = " SELECT conv_id AS query_id, reason, kept, coverage, composed, window_id, status, CAST(n_gaps AS INTEGER) AS n_gaps FROM outcome"


def _decided(spark: SparkSession, sf_dir: str, query: str, grounding: str) -> DataFrame:
    rows = B.decisions_table(B.evidence_table(_windows(spark, sf_dir, query)), grounding)
    return rows.select("query_id", "reason", F.array_join("kept", " ").alias("kept"), F.round("coverage", 6).alias("coverage"), "composed", "window_id", "status", F.size("gaps").alias("n_gaps"))


@_query(_decided_sql(ASKED, False) + _OUTCOME)
def decisions_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, ASKED, "strict")


@_query(_decided_sql(ASKED, True) + _OUTCOME)
def decisions_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, ASKED, "conversational_memory")


@_query(_decided_sql(TIED, False) + _OUTCOME)
def decisions_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, TIED, "strict")


@_query(_decided_sql(TIED, True) + f""", left_out AS (SELECT q.*, o.composed, o.window_id FROM q JOIN outcome o USING (conv_id) WHERE message_id NOT IN (SELECT message_id FROM used)),
why AS (SELECT *, list_filter([CASE WHEN len(terms) = 0 THEN 'insufficient_directness' END, CASE WHEN score < {C.MIN_SUPPORT} THEN 'filtered_by_threshold' END,
    CASE WHEN role = 'assistant' AND guess THEN 'assistant_authored_speculation' END, CASE WHEN role = 'assistant' AND NOT grounded THEN 'missing_non_assistant_grounding' END,
    CASE WHEN composed AND 'w' || wr <> window_id THEN 'outside_selected_support_window' END, CASE WHEN len(terms) < {len(L.focus_terms(TIED))} THEN 'combined_concept_not_supported' END], lambda x: x IS NOT NULL) AS found FROM left_out)
SELECT conv_id AS query_id, message_id, array_to_string(list_filter({_list(L.focus_terms(TIED))}, lambda t: NOT list_contains(terms, t)), ' ') AS missing,
  CASE WHEN len(found) > 0 THEN array_to_string(found, ' ') WHEN len(terms) > 0 THEN 'window_coverage_below_threshold' ELSE 'filtered_by_group_qualification' END AS reasons FROM why""")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.rejections_table(B.evidence_table(_windows(spark, sf_dir, TIED)), "conversational_memory")
    return rows.select("query_id", "message_id", F.array_join("missing", " ").alias("missing"), F.array_join("reasons", " ").alias("reasons"))


# --- payload of a hit, stored vectors -------------------------------------------------------------------------------


@_query(bm25_sql(M_SQL) + f""", hit AS (SELECT m.*, bm25, coalesce(p, 0) AS p, p IS NOT NULL AS held FROM m LEFT JOIN bm25 USING (message_id)
  LEFT JOIN (SELECT message_id, {C.PHRASE_BOOST} AS p FROM m WHERE contains(array_to_string(toks, ' '), 'of the')) USING (message_id) WHERE bm25 IS NOT NULL OR p IS NOT NULL),
named AS (SELECT message_id, string_agg(DISTINCT term, ' ' ORDER BY term) AS matched FROM tf WHERE term IN ({', '.join(f"'{t}'" for t in TERMS)}) GROUP BY ALL)
SELECT message_id, matched, len(toks) AS document_length, round(avgdl, 6) AS average_document_length, round(bm25, 6) AS bm25_score, held AS exact_phrase_match, round(p, 6) AS exact_phrase_boost,
  round((coalesce(bm25, 0) + p) * {VOICE_SQL}, 6) AS final_score, 'created_at_desc' AS basis, CASE WHEN length(trim(text)) > 160 THEN left(trim(text), 157) || '...' ELSE trim(text) END AS excerpt
FROM hit JOIN named USING (message_id) CROSS JOIN stats""")
def explained_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, index, parsed = messages(spark, sf_dir), _index(spark, sf_dir), R.one_query(spark, SEARCH)
    rows = R.apply_mode(R.lexical_candidates(index, found, parsed, restatements=False), "newest")
    b = F.col("match_basis.scoring_features")
    return X.explained(rows, parsed, index, "newest").where("size(matched) > 0").select(
        "message_id", F.array_join("match_basis.matched_text_terms", " ").alias("matched"), b["document_length"].cast("long").alias("document_length"), b["average_document_length"].alias("average_document_length"), b["bm25_score"].alias("bm25_score"),
        b["exact_phrase_match"].alias("exact_phrase_match"), F.round(b["exact_phrase_boost"], 6).alias("exact_phrase_boost"), b["final_score"].alias("final_score"), b["chronological_rank_basis"].alias("basis"), F.col("match_basis.focal_match_excerpt").alias("excerpt"),
    )


@_query("""SELECT 'v' || vec_id AS message_id, CASE WHEN vec_id % 2 = 0 THEN 'p' ELSE 'unknown' END AS provider, CASE WHEN vec_id % 3 = 0 THEN 7 ELSE 64 END AS embedding_dimensions, text,
  length(text) AS stored_text_length, 0 AS sequence_index, false AS truncation_occurred, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total
FROM (SELECT *, CASE WHEN vec_id % 5 = 0 THEN '' ELSE 'label ' || label END AS text FROM embeddings)""")
def embedding_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    bare = raw.select(F.concat(F.lit("v"), "vec_id").alias("message_id"), F.when(F.col("vec_id") % 2 == 0, "p").otherwise(" ").alias("provider"), F.when(F.col("vec_id") % 3 == 0, 7).alias("embedding_dimensions"), F.when(F.col("vec_id") % 5 != 0, F.concat(F.lit("label "), "label")).alias("text"), "embedding")
    rows = V.with_defaults(bare)
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total")
    return rows.select("message_id", "provider", "embedding_dimensions", "text", F.col("stored_text_length").cast("long").alias("stored_text_length"), "sequence_index", "truncation_occurred", total)


# --- narratives -----------------------------------------------------------------------------------------------------

TOLD = "what happened with the mentle"
#: Days between phases here; the product's own are weeks and months, the table is denser.
DAYS, GAP = 2, 3


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dated evidence of a query for each language."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").rlike(r"[^\t\n\f\r \p{Zs}]"))  # those whose excerpt isn't empty
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    day = F.date_format(F.date_add(F.lit("2024-01-03").cast("date"), F.pmod(F.col("doc_id") * 37, F.lit(150)).cast("int")), "yyyy-MM-dd")
    excerpt = _excerpt(F.col("text"))
    role = F.when(F.pmod("doc_id", F.lit(3)) == 0, "assistant").otherwise("user")
    rows = raw.select(F.col("lang").alias("query_id"), F.lit(TOLD).alias("query"), "doc_id", excerpt.alias("excerpt"), F.concat(day, F.lit("T10:00:00Z")).alias("created_at"), role.alias("role"))
    return rows.select(
        "query_id", "query", rank.alias("rank"), F.lit(1).alias("window_rank"), F.lit("w1").alias("window_id"), F.lit(1.0).alias("score"), "role", F.array().cast("array<string>").alias("terms"), "excerpt",
        F.concat(F.lit("d"), "doc_id").alias("message_id"), F.lit("").alias("conversation_id"), F.lit("p").alias("provider"), F.lit(None).cast("string").alias("title"), "created_at", F.lit("relevance").alias("mode"),
    )


_SKIP = sorted(t.lower() for t in L.focus_terms(TOLD))
_PHASES_SQL = f"""WITH RECURSIVE ex AS (SELECT lang AS source, doc_id, {_EXCERPT_SQL} AS text FROM documents WHERE text IS NOT NULL),
named AS (SELECT source, 'e' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, doc_id, text,
  DATE '2024-01-03' + CAST(doc_id * 37 % 150 AS INTEGER) AS day, CASE WHEN doc_id % 3 = 0 THEN 'assistant' ELSE 'user' END AS role, {_ENT_SQL} AS ents,
  list_filter(list_distinct(list_concat({_TERM_SQL}, {_ENT_SQL})), lambda w: NOT list_contains({_list(_SKIP)}, w)) AS words FROM ex WHERE text <> ''),
num AS (SELECT *, strftime(day, '%Y-%m-%d') AS d, year(day) * 365 + month(day) * 30 + day(day) AS k, row_number() OVER (PARTITION BY source ORDER BY day, rank) AS i FROM named),
walk AS (SELECT source, i, 1 AS phase, words AS acc, k FROM num WHERE i = 1
  UNION ALL SELECT w.source, n.i, CASE WHEN j THEN w.phase ELSE w.phase + 1 END, CASE WHEN j THEN list_distinct(list_concat(w.acc, n.words)) ELSE n.words END, n.k
  FROM walk w JOIN num n ON n.source = w.source AND n.i = w.i + 1
  CROSS JOIN LATERAL (SELECT abs(n.k - w.k) <= {DAYS} AND len(n.words) > 0 AND len(w.acc) > 0
    AND len(list_intersect(n.words, w.acc)) / len(list_distinct(list_concat(n.words, w.acc))) >= {C.PHASE_COHERENCE} AS j)),
placed AS (SELECT num.*, phase FROM num JOIN walk USING (source, i)),
spoken AS (SELECT source, phase, name, count(*) FILTER (role = 'user') AS u, count(*) AS c FROM (SELECT source, phase, role, unnest(ents) AS name FROM placed) GROUP BY ALL),
counted AS (SELECT source, phase, name, CASE WHEN max(u) OVER (PARTITION BY source, phase) > 0 THEN u ELSE c END AS c FROM spoken),
two AS (SELECT source, phase, string_agg(name, ', ' ORDER BY c DESC, name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY source, phase ORDER BY c DESC, name) AS r FROM counted WHERE c > 0) WHERE r <= 2 GROUP BY ALL),
built AS (SELECT source, phase, string_agg(id, ' ' ORDER BY i) AS ids, count(*) AS n, min(d) AS d0, max(d) AS d1, min(k) AS k0, max(k) AS k1, list_sort(list_distinct(flatten(list(ents)))) AS ents,
  string_agg('(' || d || ') [' || role || '] "' || CASE WHEN length(text) > 150 THEN left(text, 147) || '...' ELSE text END || '"', ' | ' ORDER BY role <> 'user', i) AS description FROM placed GROUP BY ALL),
phases AS (SELECT b.*, CASE WHEN d0 = d1 THEN d0 ELSE d0 || ' to ' || d1 END AS span, CASE WHEN d0 = d1 THEN d0 ELSE d0 || ' to ' || d1 END || coalesce(': ' || names, '') AS label FROM built b LEFT JOIN two USING (source, phase))"""


@_query(_PHASES_SQL + " SELECT source AS query_id, CAST(phase AS INTEGER) AS phase, label, description, ids, span AS date_range, CASE WHEN n = 1 THEN 'supported' ELSE 'partially_supported' END AS support FROM phases")
def narrative_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases, _, _ = B.narrative_tables(_dated(spark, sf_dir), DAYS, GAP)
    return phases.select("query_id", "phase", "label", "description", F.array_join("evidence_ids", " ").alias("ids"), "date_range", "support")


@_query(_PHASES_SQL + f"""SELECT source AS query_id, CAST(row_number() OVER (PARTITION BY source ORDER BY phase) AS INTEGER) AS gap, 'No evidence between ' || d1 || ' and ' || e0 || ' (' || (x0 - k1) || ' days)' AS description
FROM (SELECT *, lead(d0) OVER w AS e0, lead(k0) OVER w AS x0 FROM phases WINDOW w AS (PARTITION BY source ORDER BY phase)) WHERE x0 - k1 >= {GAP}""")
def narrative_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, gaps = B.narrative_tables(_dated(spark, sf_dir), DAYS, GAP)
    return gaps.drop("query")


@_query(_PHASES_SQL + """, pair AS (SELECT *, lead(label) OVER w AS label2, lead(ents) OVER w AS ents2, lead(d0) OVER w AS e0, lead(k0) OVER w AS x0 FROM phases WINDOW w AS (PARTITION BY source ORDER BY phase)),
topic AS (SELECT *, list_sort(list_filter(ents2, lambda x: NOT list_contains(ents, x))) AS fresh, list_sort(list_filter(ents, lambda x: NOT list_contains(ents2, x))) AS gone FROM pair WHERE label2 IS NOT NULL),
sign AS (SELECT *, list_filter([CASE WHEN len(fresh) > 0 THEN 'new topics: ' || array_to_string(fresh[1:3], ', ') END, CASE WHEN len(gone) > 0 THEN 'prior topics absent: ' || array_to_string(gone[1:3], ', ') END], lambda x: x IS NOT NULL) AS t FROM topic)
SELECT source AS query_id, CAST(phase AS INTEGER) AS turn, label AS from_phase, label2 AS to_phase, CASE WHEN len(t) = 0 AND x0 - k1 <= 0 THEN 'Sequential continuation' ELSE
  array_to_string(list_filter([CASE WHEN len(t) > 0 THEN 'Topic shift: ' || array_to_string(t, '; ') END, CASE WHEN x0 - k1 > 0 THEN 'Time: ' || (x0 - k1) || '-day gap (' || d1 || ' to ' || e0 || ')' END], lambda x: x IS NOT NULL), '. ') END AS description FROM sign""")
def narrative_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, turns, _ = B.narrative_tables(_dated(spark, sf_dir), DAYS, GAP)
    return turns.drop("query")


@_query(_PHASES_SQL + f""", told AS (SELECT source, phase, ids, d0, unnest({_ENT_SQL.replace('text', 'description')}) AS name FROM phases),
once AS (SELECT name, ids, arg_min(d0, (source, phase)) AS d0 FROM (SELECT CASE name WHEN 'Mark' THEN 'Marc' ELSE name END AS name, ids, d0, source, phase FROM told) GROUP BY ALL)
SELECT name, CAST(count(*) AS INTEGER) AS occurrence_count, min(d0) AS first_seen FROM once GROUP BY name HAVING count(*) >= 2""")
def narrative_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases, _, _ = B.narrative_tables(_dated(spark, sf_dir), DAYS, GAP)
    return B.recurring_table(phases)
