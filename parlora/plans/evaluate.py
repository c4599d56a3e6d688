"""Benchmark of answers against a bank of queries."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import asdict, dataclass
from pathlib import Path

from .. import constants as C
from ..functions import local as L
from . import answer as A


@dataclass(frozen=True)
class Case:
    """A query with what its answer should be like."""

    id: str
    query: str
    expected_status: str
    retrieval_mode: str = "relevance"
    expected_terms_any: tuple[str, ...] = ()
    expected_terms_all: tuple[str, ...] = ()
    forbidden_terms: tuple[str, ...] = ()
    expected_min_citations: int | None = None
    expected_max_citations: int | None = None
    notes: str | None = None


@dataclass(frozen=True)
class CaseResult:
    """How one case fared."""

    case_id: str
    query: str
    expected_status: str
    actual_status: str
    passed: bool
    failure_types: tuple[str, ...]
    metrics: dict[str, bool]
    citation_count: int
    evidence_used_count: int
    answer: str
    notes: str | None = None


@dataclass(frozen=True)
class Summary:
    """How the bank fared."""

    run_id: str
    bench_path: str
    bench_cases: int
    passed: int
    failed: int
    status_accuracy: float
    failure_type_counts: dict[str, int]


def load_bank(path: str) -> list[Case]:
    """Cases of a JSON array; values of the wrong type count as absent."""
    rows = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(rows, list):
        raise ValueError("a query bank is a JSON array")
    strings = lambda v: tuple(x for x in v if isinstance(x, str)) if isinstance(v, list) else ()
    whole = lambda v: v if isinstance(v, int) and not isinstance(v, bool) else None
    out = []
    for r in (r for r in rows if isinstance(r, dict)):
        text = {k: r[k] for k in ("id", "query", "expected_status", "retrieval_mode", "notes") if isinstance(r.get(k), str)}
        text.setdefault("id", ""), text.setdefault("query", ""), text.setdefault("expected_status", "")
        out.append(Case(**text, **{k: strings(r.get(k)) for k in ("expected_terms_any", "expected_terms_all", "forbidden_terms")}, **{k: whole(r.get(k)) for k in ("expected_min_citations", "expected_max_citations")}))
    return out


def metrics(case: Case, out: A.Answer) -> dict[str, bool]:
    """Eight yes-or-no measures of an answer."""
    norm = lambda t: " ".join(L.tokens(t))
    excerpts = [norm(i.excerpt) for i in out.evidence]
    held = {w for e in excerpts if e for w in (e, *e.split())}
    keys = ("provider", "conversation_id", "message_id", "excerpt")
    evidence = {tuple(i.citation()[k] for k in keys) for i in out.evidence}
    n = len(out.citations)
    low, high = case.expected_min_citations, case.expected_max_citations
    said = norm(" ".join([out.text, *(i.excerpt for i in out.evidence)]))
    focus = {t for t in L.tokens(case.query) if len(t) >= 2 and t not in C.EVAL_STOPWORDS}
    leak = bool(out.evidence) and len(focus) >= 2 and "'s " in case.query.lower() and all(i.role == "assistant" for i in out.evidence)
    return {
        "status_match": out.status == case.expected_status,
        "citation_count_ok": (low is None or n >= low) and (high is None or n <= high),
        "citation_trace_valid": all(tuple(c[k] for k in keys) in evidence for c in out.citations),
        "evidence_term_coverage_any": not case.expected_terms_any or any(norm(t) in held for t in case.expected_terms_any),
        "evidence_term_coverage_all": all(norm(t) in held for t in case.expected_terms_all),
        "forbidden_term_ok": not any(norm(t) and norm(t) in said for t in case.forbidden_terms),
        "assistant_support_leakage": not leak,
        "empty_support_correctness": bool(out.evidence) or out.status == A.INSUFFICIENT,
    }


_FALSE = {A.SUPPORTED: "false_supported", A.PARTIAL: "false_partial", A.AMBIGUOUS: "false_ambiguous"}
_MISSED = {A.SUPPORTED: "missed_support", A.PARTIAL: "missed_partial", A.AMBIGUOUS: "missed_ambiguity"}
_BY_METRIC = {
    "evidence_term_coverage_any": "topical_drift", "evidence_term_coverage_all": "multipart_coverage_failure", "citation_trace_valid": "citation_integrity_failure", "citation_count_ok": "citation_count_failure",
    "forbidden_term_ok": "forbidden_term_violation", "assistant_support_leakage": "assistant_leakage",
}


def failures(case: Case, status: str, measured: dict[str, bool]) -> tuple[str, ...]:
    """Kinds of failure, each once, in a fixed order."""
    found = [] if measured["status_match"] else [_FALSE.get(status), _MISSED.get(case.expected_status)]
    found += [kind for name, kind in _BY_METRIC.items() if not measured[name]]
    return tuple(dict.fromkeys(f.upper() for f in found if f))


def judge(case: Case, out: A.Answer) -> CaseResult:
    """One case's result."""
    measured = metrics(case, out)
    kinds = failures(case, out.status, measured)
    return CaseResult(case.id, case.query, case.expected_status, out.status, all(measured.values()) and not kinds, kinds, measured, len(out.citations), len(out.evidence), out.text, case.notes)


def summarize(results: list[CaseResult], run_id: str = "", path: str = "") -> Summary:
    """Counts over all cases."""
    n, passed = len(results), sum(r.passed for r in results)
    right = sum(r.expected_status == r.actual_status for r in results)
    return Summary(run_id, path, n, passed, n - passed, right / n if n else 0.0, dict(Counter(k for r in results for k in r.failure_types)))


def report_json(s: Summary, results: list[CaseResult]) -> str:
    """Stable JSON."""
    return json.dumps({"summary": asdict(s), "results": [asdict(r) for r in results]}, ensure_ascii=True, indent=2, sort_keys=True) + "\n"


def render(s: Summary, results: list[CaseResult], failed_only: bool = False) -> str:
    """The report as text."""
    lines = ["Eval Summary", *(f"{k}: {getattr(s, k)}" for k in ("run_id", "bench_cases", "passed", "failed")), f"status_accuracy: {s.status_accuracy:.2f}", "failure_types:"]
    lines += [f"  {k}: {n}" for k, n in sorted(s.failure_type_counts.items())] or ["  (none)"]
    shown = [r for r in results if not (failed_only and r.passed)]
    for k, r in enumerate(shown):
        lines += ["", "Cases:"] * (k == 0)
        lines.append(f"  - id={r.case_id} passed={r.passed} expected_status={r.expected_status} actual_status={r.actual_status}")
        lines += [f"    failure_types={', '.join(r.failure_types)}"] * bool(r.failure_types) + [f"    notes={r.notes}"] * bool(r.notes)
    return "\n".join(lines)
