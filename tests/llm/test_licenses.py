import math
import random
import re
from collections import Counter

import pytest
from parlora.llm.license_texts import NOTICES
from parlora.llm.licenses import CONTAINMENT, GUARANTEE, TEMPLATES, Scanner, scan_licenses

from .conftest import SCHEMA, row, words


def bigrams(text):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return [tuple(w[i : i + 2]) for i in range(max(len(w) - 1, min(len(w), 1)))], len(w)


def brute(text, template):
    """Occurrences by looking at every stretch of the whole text, without windows or hashes."""
    (own, _), (wanted, n) = bigrams(text), bigrams(template)
    times, wanted, m = Counter(wanted), set(wanted), 1 << max(1, (math.ceil(1.2 * n) - 1).bit_length())
    need, longest, out, begin = math.ceil(CONTAINMENT * len(wanted) - 1e-9), max(1, m - 1), [], 0
    end = 0
    while end < len(own):
        a = max(begin, end - longest + 1)
        while a <= end and (own[a] not in wanted or own[a : end + 1].count(own[a]) > times[own[a]]):
            a += 1
        held = set(own[a : end + 1]) & wanted
        if own[end] in wanted and len(held) >= need:
            last, p = end, end + 1
            while p < len(own) and p - a < longest:
                if own[p] in wanted:
                    if own[a:p].count(own[p]) >= times[own[p]]:
                        break
                    held.add(own[p])
                    last = p
                p += 1
            out.append((len(held) / len(wanted), a, last + 2))
            begin = end = last + 1
        else:
            end += 1
    return out


def found(spark, texts):
    rows = scan_licenses(spark.createDataFrame([row(d, t) for d, t in texts.items()], SCHEMA)).collect()
    return sorted((r["doc_id"], r["license"], round(r["containment"], 9), r["start_token"], r["end_token"]) for r in rows)


def wanted(texts, templates=TEMPLATES):
    return sorted((d, n, round(s, 9), a, b) for d, t in texts.items() for n, x in templates.items() for s, a, b in brute(t, x))


def test_every_template_is_found_anywhere(spark):
    rows, want = [], set()
    for i, (name, text) in enumerate(sorted(TEMPLATES.items())):
        for k, before in enumerate((0, 1, 7, 133, 1000)):
            rows.append(row(i * 10 + k, f"{words(before, k)} {text}. {words(50, i)}"))
            want.add((i * 10 + k, name))
    got = scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert want <= {(r["doc_id"], r["license"]) for r in got if r["containment"] == 1}
    assert all(r["containment"] >= CONTAINMENT for r in got)


def test_bands_guarantee_retrieval():
    scanner = Scanner(TEMPLATES, CONTAINMENT, GUARANTEE)
    for group in scanner.groups:
        for i in group.members:
            need = scanner.needs[i]
            assert 1 - (1 - need / (2 * group.m + len(scanner.sets[i]) - need)) ** group.bands >= GUARANTEE - 1e-12


def test_finds_of_the_tables_equal_brute_force(docs, texts):
    got = sorted((r["doc_id"], r["license"], round(r["containment"], 9), r["start_token"], r["end_token"]) for r in scan_licenses(docs).collect())
    assert got and got == wanted(texts, NOTICES) and wanted({d: t for d, t in list(texts.items())[:60]}) == [r for r in got if r[0] in list(texts)[:60]]


def test_repeated_notices_are_found_each(spark):
    texts = {1: "All rights reserved. " * 10, 2: "Released under the MIT License. " * 5, 3: f"All rights reserved. {words(30, 1)} All rights reserved.", 4: (TEMPLATES["mit-text"] + " ") * 3}
    got = found(spark, texts)
    assert [r[3:] for r in got if r[0] == 1] == [(3 * i, 3 * i + 3) for i in range(10)]
    assert [r[3:] for r in got if r[0] == 2] == [(5 * i, 5 * i + 5) for i in range(5)]
    assert [r[3:] for r in got if r[0] == 3] == [(0, 3), (33, 36)] and len([r for r in got if r[:2] == (4, "mit-text")]) == 3
    assert got == wanted(texts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_altered_and_mixed_texts_equal_brute_force(spark, seed):
    rng, texts = random.Random(seed), {}
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            w = TEMPLATES[rng.choice(sorted(TEMPLATES))].split()
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = rng.choice(([], ["odd"], ["the", "work"]))
            parts += [*w[: rng.choice((len(w), len(w), rng.randint(1, len(w))))], words(rng.randint(1, 40), rng.random())]
        texts[d] = " ".join(parts)
    got, want = found(spark, texts), wanted(texts)
    assert len(want) > 60 and got == want


def test_near_and_far_wordings(spark):
    near = TEMPLATES["mit-permission"].replace("charge", "fee")
    far = "permission is granted to any person who asks nicely"
    got = found(spark, {1: near, 2: far, 3: "Licensed under CC BY-NC 4.0."})
    assert {r[:2] for r in got} == {(1, "mit-permission"), (3, "cc-by-nc-4.0")}


def test_odd_rows(odd, none):
    assert scan_licenses(odd).count() == 0
    assert scan_licenses(none).count() == 0
