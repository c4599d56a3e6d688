import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from parlora.llm.piece_codec import MODEL, apply_edits, codec, decode, encode, n_best

from .conftest import words


@pytest.fixture(scope="module")
def own():
    return codec(MODEL, 4)


def every_path(edges):
    out = []

    def walk(j, score):
        if j == 0:
            out.append(score)
        for i, _, s in edges[j] if j else ():
            walk(i, score + s)

    walk(len(edges) - 1, 0.0)
    return sorted(out, reverse=True)


def test_n_best_equals_all_paths(own):
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("theandingou éß\n▁x") for _ in range(rng.randint(1, 11)))
        edges = own.pieces.edges(" " + text)
        want = every_path(edges)
        assert [round(s, 4) for s, _ in n_best(edges, 4)] == [round(s, 4) for s in want[:4]]
        ids, _, scores, more = own.encode([text])
        assert [round(s, 4) for s in [scores[0], *(a["score"] for a in more[0])]] == [round(s, 4) for s in want[:4]]
        for a in more[0]:
            assert own.pieces.decode(apply_edits(ids.tolist(), a["edits"])) == text


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
def test_round_trip(text):
    own = codec(MODEL, 4)
    ids, _, _, more = own.encode([text])
    assert own.pieces.decode(ids.tolist()) == text
    assert all(own.pieces.decode(apply_edits(ids.tolist(), a["edits"])) == text for a in more[0])


def test_library_decodes_the_ids(docs, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = encode(docs).collect()
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows)
    for r in rows[:60]:
        assert model.decode(list(r["ids"])) == texts[r["doc_id"]]
        assert r["n_pieces"] == len(r["ids"]) and [a["rank"] for a in r["alternatives"]] == list(range(2, len(r["alternatives"]) + 2))
        scores = [r["score"], *(a["score"] for a in r["alternatives"])]
        assert scores == sorted(scores, reverse=True)


def test_decode_table(docs, texts):
    got = {r["doc_id"]: r["text"] for r in decode(encode(docs).select("doc_id", "ids")).collect()}
    assert got == texts


def test_odd_rows(odd, none):
    rows = encode(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["round_trip"] in (True, None) and (r["ids"] is None) == (r["round_trip"] is None)
    empty = [r for r in rows if r["doc_id"] in (4, 5)]
    assert all(r["ids"] == [] and r["score"] == 0 and r["alternatives"] == [] for r in empty)
    assert encode(none).count() == 0


def test_long_and_short_units_take_the_same_segmentations(monkeypatch):
    """Units beyond a length go another way through Viterbi; with the length at 3 all words of the text do."""
    from parlora.llm import piece_codec as module

    texts = ["  the quick brown foxes jumped over internationalization " + words(40, 4), "x" * 60 + " ééé 🙂 a▁b", "", "aaaa " * 30]
    one = module.Codec(module.Pieces(), 4).encode(texts)
    monkeypatch.setattr(module, "_LONG_UNIT", 3)
    other = module.Codec(module.Pieces(), 4).encode(texts)
    assert one[0].tolist() == other[0].tolist() and one[1].tolist() == other[1].tolist()
    assert max(abs(a - b) for a, b in zip(one[2], other[2])) < 1e-4
    flat = lambda found: [[[(e["start"], e["length"], list(e["ids"])) for e in alt["edits"]] for alt in of] for of in found[3]]
    assert flat(one) == flat(other)


def test_units_and_texts_met_before_are_not_segmented_again(spark, monkeypatch):
    """A batch costs what is new in it; what was dropped in between gives the same again."""
    from parlora.llm import piece_codec as module

    texts = [words(300, s) for s in range(6)] + ["x" * 60 + " é🙂 a▁b", "", "aaaa " * 30]
    same = lambda found: (found[0].tolist(), found[1].tolist(), [round(float(s), 4) for s in found[2]], found[3])
    searched = []
    units = module.Codec.units
    monkeypatch.setattr(module.Codec, "units", lambda self, new: searched.extend(new) or units(self, new))
    own = module.Codec(module.Pieces(), 4)
    first = same(own.encode(texts))
    once = len(searched)
    assert same(own.encode(texts)) == first
    assert once == len(set(searched[:once])) and {u for u in searched[once:]} == {u for u in searched if len(u) > 48}
    monkeypatch.setattr(module, "_KEPT", 40)
    assert [same(own.encode([t])) for t in texts] == [same(module.Codec(module.Pieces(), 4).encode([t])) for t in texts]
    assert same(own.encode(texts)) == first
    rows = spark.createDataFrame([(1, texts[0]), (2, None), (3, texts[0]), (4, texts[1]), (5, None), (6, "")], "doc_id long, text string").coalesce(1)
    by = {r["doc_id"]: tuple(r)[1:] for r in encode(rows).collect()}
    assert len(by) == 6 and by[1] == by[3] and by[1][2] != by[4][2] and by[2] == by[5] == (None,) * 5 and by[6] == (0, 0.0, [], [], True)
