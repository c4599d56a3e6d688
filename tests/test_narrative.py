from parlora.plans import narrative as N
from parlora.plans import patterns as P
from parlora.plans import positions as S
from parlora.plans import router
from parlora.plans.evidence import Evidence


def ev(rank, text, at=None, role="user"):
    return Evidence(rank, 1, "w", 1.0, role, (), text, f"m{rank}", created_at=at)


def phase(ids, description, span=None, label=None):
    return N.Phase(label or span or "p", description, tuple(ids), span, "supported")


def test_phases_need_time_and_topic():
    items = (ev(1, "garden plants growing", "2024-01-01T00:00:00Z"), ev(2, "garden plants dying", "2024-01-05T00:00:00Z"), ev(3, "guitar lessons", "2024-01-06T00:00:00Z"), ev(4, "guitar lessons", "2024-03-20T00:00:00Z"), ev(5, "guitar lessons"))
    n = N.build("life", items)
    assert [p.evidence_ids for p in n.timeline] == [("e1", "e2"), ("e3",), ("e4",), ("e5",)]
    assert n.timeline[0].date_range == "2024-01-01 to 2024-01-05" and n.timeline[0].support == "partially_supported"
    assert [g.description for g in n.gaps] == ["No evidence between 2024-01-06 and 2024-03-20 (74 days)"]
    assert [x.kind for x in n.limitations] == ["null_timestamp"]
    assert n.summary.startswith("The evidence spans from 2024-01-01 to 2024-03-20 across 4 phase(s). 4 of 4 phase(s) grounded")
    assert "Time: 74-day gap (2024-01-06 to 2024-03-20)" in n.transitions[1].description
    assert N.build("x", ()).summary == "No evidence was retrieved for this query." and "Timeline:" in N.render(n, True)


def test_phase_words():
    p = N.make_phase([ev(2, "Anna and Zoe", "2024-01-02", "assistant"), ev(1, "met Bob", "2024-01-02")])
    assert p.label == "2024-01-02: Bob" and p.description == '(2024-01-02) [user] "met Bob" | (2024-01-02) [assistant] "Anna and Zoe"'
    assert N.make_phase([ev(1, "no names")]).label == "Phase (evidence e1)"


def test_turns():
    a, b = [ev(1, "feeling great")], [ev(2, "so worried")]
    assert N.transition(N.make_phase(a), N.make_phase(b), a, b).description == "Tone shift: positive to negative"
    c = [ev(3, "then I moved to a far away city with my whole family and it was quite a change")]
    assert N.transition(N.make_phase(a), N.make_phase(c), a, c).description.startswith('Stated change: "then I moved to a far')
    assert N.transition(N.make_phase(a), N.make_phase(a), a, a).description == "Sequential continuation"


def test_positions():
    p = phase(["e1", "e2"], '(2024-01-01) [user] "Well. I think Anna is right. I don’t believe it" | [assistant] "I think so"', "2024-01-01")
    got = S.extract(p)
    assert [(x.text, x.entity, x.stance_marker, x.evidence_id) for x in got] == [("I think Anna is right.", "Anna", "i think", "e1"), ("I don’t believe it", None, "i don't believe", "e1")]
    assert S.extract(phase([], '[user] "I think"')) == ()


def pos(text, date=None, marker="i think", entity=None):
    return S.Position(text, date, entity, "e1", marker)


def test_shifts_and_change_types():
    def kind(a, b):
        found = S.contradictions("x", [a, b])
        return (found[0].signal, found[0].change_type, found[0].date_range) if found else None

    first = pos("I think it is good", "2024-01-01")
    assert kind(first, pos("now", "2024-02-01", "i changed my mind")) == ('explicit self-revision detected: "i changed my mind"', "reversal", "2024-01-01 to 2024-02-01")
    assert kind(first, pos("I never liked it", "2024-02-01"))[:2] == ("possible shift: negation introduced in later position", "reversal")
    assert kind(pos("I decided not to", "2024-01-01", "i decided"), pos("I feel like going", "2024-02-01", "i feel like"))[:2] == ("possible shift: negation removed in later position", "softening")
    assert kind(first, pos("I think it is bad", "2024-02-01"))[:2] == ("possible shift from positive to negative stance", "reversal")
    assert kind(first, pos("I think it is fine", "2024-02-01")) is None
    assert S.order(pos("a")) > S.order(pos("z", "2024"))
    assert len(S.about((pos("Anna came", entity=None), pos("x", entity="anna")), "Anna")) == 1 and S.about((pos("Anna came"),), "anna") and not S.about((pos("Annabel"),), "Anna")


def narrative(*phases, query="people"):
    return N.Narrative(query, "", tuple(phases), (), (), (), len(phases))


PHASES = (
    phase(["e1"], '(2024-01-01) [user] "I think Anna loves gardening and painting"', "2024-01-01"),
    phase(["e2"], '(2024-01-03) [user] "Anna enjoys gardening and painting with Mark"', "2024-01-03"),
    phase(["e3"], '(2024-01-05) [user] "I was wrong about Anna, and Marc likes gardening"', "2024-01-05"),
    phase(["e4"], '(2024-06-05) [user] "numbers spreadsheet finance"', "2024-06-05"),
)


def test_report():
    r = P.report([narrative(*PHASES)])
    assert [(e.name, e.occurrence_count) for e in r.entities] == [("Anna", 3), ("Marc", 2)]
    assert len(r.clusters) == 1 and r.clusters[0].phase_count == 3 and r.clusters[0].key_entities == ("Anna", "Marc")
    assert [(b.date_range, b.burst_size, b.entities) for b in r.temporal_bursts] == [("2024-01-01 to 2024-01-05", 3, ("Anna", "Marc"))]
    assert r.entities[1].occurrences[0].excerpt.endswith("with Mark")
    again = P.report([narrative(PHASES[0]), narrative(PHASES[0], query="other")])
    assert again.entities == () and again.query == "people; other" and P.report([]).evidence_count == 0
    assert "Recurring entities (2):" in P.render(r)


def test_merging_takes_the_first_of_equals():
    assert P.merge_clusters([{"a", "b"}, {"a", "c"}, {"b", "d"}, {"z"}]) == [[0, 1, 2], [3]]
    assert P.merge_clusters([]) == [] and P.merge_clusters([set(), set()]) == [[0], [1]]


def test_bursts_dont_overlap():
    assert P.burst_ranges(["2024-01-01", "2024-01-02", "2024-01-08", "2024-01-09", "2024-01-10", "2024-01-11"]) == [(0, 3), (3, 6)]
    assert P.burst_ranges(["2024-01-01", "2024-01-02"]) == []


def test_intents():
    r = P.report([narrative(*PHASES)])
    kinds = {
        "Where did I contradict myself?": "contradiction", "Have I changed my mind": "contradiction", "How did my thinking about Anna change?": "evolution", "What happened with Anna?": "entity_scoped",
        "Who are the main people?": "entity", "main themes": "theme", "connect across topics": "cross_topic", "busy periods": "temporal", "progress over time": "timeline", "hello": "unknown", "What about Anna's job": "entity_scoped" if router.find_entity("Anna's", r) else "unknown",
    }
    assert {q: router.classify(q, r) for q in kinds} == kinds
    assert router.classify("my journey") == "evolution" and router.find_entity("anna and marc", r) == "Anna"


def test_answers():
    n = [narrative(*PHASES)]
    r = P.report(n)
    say = lambda q: router.route(q, r, n)
    assert "possible reversal" in say("Did I contradict myself about Anna?") and "Possible evolution detected." in say("How did my thinking about Anna change?")
    assert say("What happened with Anna?").startswith("Anna — 3 occurrences") and "Timeline (3 phases):" in say("What happened with Anna?")
    assert say("Who are the main people?").split("\n")[2] == "  1. Anna — 3 occurrences, span 2024-01-01 to 2024-01-05"
    assert "clusters" in say("main themes") and say("connect across") == "No entities bridge multiple topic clusters."
    assert "3 phases — involving Anna, Marc" in say("busy periods") and "Activity concentration:" in say("progress over time") and "Who are the main people?" in say("hello")
    empty = P.Report()
    assert router.route("hello", empty, []).startswith("I can answer") and "Insufficient evidence" in router.route("contradict", empty, [])
    phases, turns = router.scoped(n, "Marc")
    assert len(phases) == 1 and turns == []


def test_tables_in_blocks_equal_whole_narratives(spark, monkeypatch):
    import random

    from parlora.plans import batch as B

    draw = random.Random(3)
    words = ("garden", "plants", "guitar", "lessons", "Anna", "Berlin", "Marc", "Mark")
    rows = [
        (q, "life", rank, 1, "w1", 1.0, draw.choice(["user", "assistant", None]), [], " ".join(draw.choices(words, k=draw.randint(1, 3))), f"m{rank}", "", "p", None, draw.choice([None, "", f"2024-{draw.randint(1, 6):02}-{draw.randint(1, 28):02}T00:00:00Z"]), "relevance")
        for q in ("a", "b", None) for rank in range(1, 41)
    ]
    evidence = spark.createDataFrame(rows, "query_id string, query string, " + B._EVIDENCE)
    monkeypatch.setattr(B, "BLOCK", 3)
    monkeypatch.setattr(B, "BATCH", 5)
    phases, turns, holes = B.narrative_tables(evidence, 20, 5)
    told = {q: N.build("life", tuple(Evidence(r[2], 1, "w1", 1.0, r[6], (), r[8], r[9], "", "p", None, r[13]) for r in rows if r[0] == q), 20, 5) for q in ("a", "b", None)}
    plain = lambda df: sorted(map(repr, (tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())))
    assert plain(phases) == sorted(repr((q, "life", k, p.label, p.description, p.evidence_ids, p.date_range, p.support)) for q, n in told.items() for k, p in enumerate(n.timeline, 1))
    assert plain(turns) == sorted(repr((q, "life", k, t.from_phase, t.to_phase, t.description)) for q, n in told.items() for k, t in enumerate(n.transitions, 1))
    assert plain(holes) == sorted(repr((q, "life", k, g.description)) for q, n in told.items() for k, g in enumerate(n.gaps, 1))
    assert max(len(n.timeline) for n in told.values()) > 6 and sum(len(n.gaps) for n in told.values()) > 3
    ordered = [n for n in (told[q] for q in (None, "a", "b"))]
    assert sorted(tuple(r) for r in B.recurring_table(phases).collect()) == sorted((e.name, e.occurrence_count, e.occurrences[0].created_at) for e in P.recurring(ordered))
