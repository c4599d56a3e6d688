import json

import pytest
from parlora.plans import answer as A
from parlora.plans import evaluate as V
from parlora.plans import evidence as E


def ev(rank, text, terms=(), role="user", score=1.0, window=1, at=None):
    return E.Evidence(rank, window, f"w{window}", score, role, tuple(terms), text, f"m{rank}", "c", "chatgpt", None, at)


def message(k, text, role="user"):
    return {"message_id": f"m{k}", "conversation_id": "c", "author_role": role, "text": text, "provider": "chatgpt", "created_at": None}


def window(rank, *messages):
    return {"rank": rank, "result_id": f"w{rank}", "score": 2.0, "messages": list(messages)}


def test_support_order():
    m = [message(0, "hello"), message(1, "about tax", "assistant"), message(2, "more tax"), message(3, "fine", "assistant"), message(4, "bye")]
    assert [x["message_id"] for x in E.support_order(m, ("tax",))] == ["m1", "m2", "m3"]
    assert E.support_order(m, ("volcano",)) == []


def test_cap_is_passed_by_a_window_that_ends_on_it():
    two = lambda r: window(r, message(10 * r, "tax a"), message(10 * r + 1, "tax b"))
    one = window(3, message(99, "tax c"))
    assert len(E.select([two(1), two(2), one], "tax", 4)) == 5
    assert len(E.select([one, two(1), two(2)], "tax", 1)) == 1


def test_assistants_need_grounding():
    focus, bold = ("tax", "audit"), ev(1, "tax audit", ("tax", "audit"), "assistant")
    assert not E.qualifies(bold, focus, (bold,))
    assert E.qualifies(bold, focus, (bold, ev(2, "tax audit", ("tax", "audit"))))
    assert not E.qualifies(bold, focus, (bold, ev(2, "maybe tax audit", ("tax", "audit"))))
    assert not E.qualifies(bold, focus, (bold, ev(2, "tax audit", ("tax", "audit"), window=2)))
    guess = ev(3, "perhaps tax audit", ("tax", "audit"), "assistant")
    assert not E.qualifies(guess, focus, (guess, ev(2, "tax audit", ("tax", "audit"))))


def test_composition():
    items = (ev(1, "the tax form", ("tax",)), ev(2, "an audit came", ("audit",)))
    assert E.qualify("tax audit", items).reason == "strict_partial_support"
    kept = E.qualify("tax audit", items, "conversational_memory")
    assert kept.composed and kept.coverage == 1 and A.decide("tax audit", kept).status == "partially_supported"
    apart = (items[0], ev(2, "an audit came", ("audit",), window=2))
    assert not E.qualify("tax audit", apart, "conversational_memory").composed
    with pytest.raises(ValueError):
        E.qualify("x", items, "loose")


def test_statuses():
    decide = lambda q, *items: A.decide(q, E.qualify(q, items)).status
    assert decide("tax audit") == "insufficient_evidence"
    assert decide("tax audit", ev(1, "tax audit", ("tax", "audit"))) == "supported"
    assert decide("tax audit", ev(1, "tax", ("tax",))) == "partially_supported"
    assert decide("Anna's audit", ev(1, "anna", ("anna",))) == "insufficient_evidence"
    assert decide("tax", ev(1, "tax", ("tax",), score=0.1)) == "insufficient_evidence"
    assert decide("tax", ev(1, "tax got better", ("tax",)), ev(2, "tax got worse", ("tax",))) == "ambiguous"


def test_wording():
    a = A.answer("tax audit", [window(1, message(1, "my tax audit went on"))])
    assert a.text == 'Based on the retrieved evidence: "my tax audit went on".'
    none = A.answer("volcano ash", [window(1, message(1, "volcano", "assistant"))])
    assert none.gaps == ("Relevant retrieval candidates were found, but none met the evidence qualification rules for this question.",)
    assert none.rejected[0]["reasons"] == ("missing_non_assistant_grounding",)
    assert json.loads(a.to_json())["answer_status"] == "supported" and "citations:" in a.render()
    many = A.write(A.Decision(A.SUPPORTED), (ev(1, "later", at="2024-02-01T00:00:00Z"), ev(2, "first", at="2024-01-01T00:00:00Z"), ev(3, "x" * 200)))
    assert many.split("\n")[1:] == [f'- "{"x" * 117}..."', '- (2024-01-01) "first"', '- (2024-02-01) "later"']
    assert [i.rank for i in A.synthesis_entries((ev(1, "a" * 70, role="assistant"), ev(2, "b"), ev(3, "A" * 65)))] == [2, 3]


def test_citations_are_unique():
    assert [c["excerpt"] for c in E.citations((ev(1, "a"), ev(2, "b"), E.replace(ev(3, "c"), message_id="m1")))] == ["a", "b"]


def test_writers():
    base = A.answer("tax audit", [window(1, message(1, "my tax audit went on with Anna"))])
    good = A.rewrite(base, lambda i, p: json.dumps({"answer_text": "So, my tax audit went on.", "citation_ids": ["e1"]}))
    assert good.synthesis == "llm" and good.text == "So, my tax audit went on."
    bad = ["no json", json.dumps({"answer_text": "x", "citation_ids": ["e9"]}), json.dumps({"answer_text": "x", "citation_ids": []}), json.dumps({"answer_text": "It was with Zoe.", "citation_ids": ["e1"]}), json.dumps({"answer_text": "in 1999", "citation_ids": ["e1"]})]
    for raw in bad:
        out = A.rewrite(base, lambda i, p, raw=raw: raw, hybrid=True)
        assert out.synthesis == "hybrid_fallback" and out.text == base.text


def test_checks_of_written_answers():
    items = (ev(1, "my tax audit went on", at="2024-01-01"), ev(2, "it ended well", at="2024-02-01"))
    check = lambda text, ids=("e1",), status="supported": A.check_written(text, ids, "tax", items, status)[0]
    assert check("In 2024 my tax audit went on") == "valid"
    assert check("my tax audit went on") == "degraded" and check("In 2024 all was fine") == "degraded"
    assert check("In 2024 my tax audit went on with Zoe") == "invalid" and check("In 2024 my tax audit went on", ("e9",)) == "invalid"
    assert check("In 2024 my tax audit went on, the answer is clear", status="partially_supported") == "invalid"


def test_benchmark(tmp_path):
    out = A.answer("tax audit", [window(1, message(1, "my tax audit went on"))])
    fine = V.judge(V.Case("a", "tax audit", "supported", expected_terms_any=("tax",), expected_terms_all=("Tax", "audit"), expected_min_citations=1), out)
    assert fine.passed and not fine.failure_types
    bad = V.judge(V.Case("b", "tax audit", "ambiguous", expected_terms_any=("zoo",), expected_terms_all=("tax", "zoo"), forbidden_terms=("audit",), expected_max_citations=0), out)
    assert bad.failure_types == ("FALSE_SUPPORTED", "MISSED_AMBIGUITY", "TOPICAL_DRIFT", "MULTIPART_COVERAGE_FAILURE", "CITATION_COUNT_FAILURE", "FORBIDDEN_TERM_VIOLATION")
    s = V.summarize([fine, bad])
    assert (s.passed, s.failed, s.status_accuracy) == (1, 1, 0.5)
    assert "id=a" not in V.render(s, [fine, bad], True) and json.loads(V.report_json(s, [fine, bad]))["summary"]["passed"] == 1
    p = tmp_path / "bank.json"
    p.write_text(json.dumps([{"id": "x", "query": "q", "expected_status": "supported", "expected_min_citations": "2", "forbidden_terms": ["a", 1]}, 7]))
    assert V.load_bank(str(p)) == [V.Case("x", "q", "supported", forbidden_terms=("a",))]
    leak = A.Answer("Anna's tax", "supported", "t", (ev(1, "anna tax", ("anna", "tax"), "assistant"),), (), (), [], E.Qualified(), [], 1)
    assert not V.metrics(V.Case("c", "Anna's tax", "supported"), leak)["assistant_support_leakage"]
