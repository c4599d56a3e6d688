import random
import re
from collections import Counter

from parlora.llm.language_id import SIZE, identify_languages, keep_identified, train_limits, train_profiles


def counts(text):
    s = re.sub(r"[\W\d_]+", "_", f"_{text.lower()}_")
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if g == "_" or g == "__" or (n == 3 and g[1] == "_"):
                continue
            out[g] += 1
    return out


def profile(c):
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:SIZE]]


def test_equals_brute_force(docs):
    rows = docs.collect()
    total = {}
    for r in rows:
        total.setdefault(r["lang"], Counter()).update(counts(r["text"]))
    ranks = {lang: {g: k for k, g in enumerate(profile(c))} for lang, c in total.items()}
    got = {r["doc_id"]: r for r in identify_languages(docs).collect()}
    right = 0
    for r in rows:
        own = profile(counts(r["text"]))
        far = {lang: sum(abs(k - p[g]) if g in p else SIZE for k, g in enumerate(own)) for lang, p in ranks.items()}
        best = min(sorted(far), key=far.get)
        assert (got[r["doc_id"]]["detected"], got[r["doc_id"]]["distance"], got[r["doc_id"]]["n_grams"]) == (best, far[best], len(own))
        right += best == r["lang"]
    assert right >= 0.98 * len(rows)


def test_held_out_accuracy(docs):
    profiles = train_profiles(docs.where("doc_id % 2 = 0"))
    rows = identify_languages(docs.where("doc_id % 2 = 1"), profiles).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["detected"] == r["lang"] for r in rows) >= 0.98 * len(rows)
    assert all(r["accepted"] for r in rows)


def test_other_scripts_are_rejected(spark, docs):
    strange = spark.createDataFrame([(1, "Это русский текст о погоде"), (2, "これは日本語の文章です"), (3, "12345 !!!"), (4, None)], "doc_id long, text string")
    got = identify_languages(strange, train_profiles(docs)).collect()
    assert [r["accepted"] for r in sorted(got, key=lambda r: r["doc_id"])] == [False] * 4


FOREIGN = {
    1: "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura ché la diritta via era smarrita e quanto a dir qual era è cosa dura questa selva selvaggia e aspra e forte che nel pensier rinnova la paura tant'è amara che poco è più morte ma per trattar del ben ch'io vi trovai dirò dell'altre cose ch'io v'ho scorte",
    2: "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan, sukuvirttä suoltamahan, lajivirttä laulamahan. Sanat suussani sulavat, puhe'et putoelevat, kielelleni kerkiävät, hampahilleni hajoovat.",
    3: "Litwo, ojczyzno moja, ty jesteś jak zdrowie, ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej ozdobie widzę i opisuję, bo tęsknię po tobie. Panno święta, co jasnej bronisz Częstochowy i w Ostrej świecisz Bramie",
    4: "Korkma sönmez bu şafaklarda yüzen al sancak, sönmeden yurdumun üstünde tüten en son ocak. O benim milletimin yıldızıdır parlayacak, o benimdir o benim milletimindir ancak. Çatma kurban olayım çehreni ey nazlı hilal",
}


def test_other_languages_and_gibberish_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(3)
    junk = {10 + i: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)) for i, (letters, n) in enumerate((a, n) for a in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz") for n in (40, 200, 3000))}
    mixed = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(-d, t, None) for d, t in (FOREIGN | junk).items()], "doc_id long, text string, lang string"))
    want = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in identify_languages(mixed).where("accepted").collect()} == want
    assert {r["doc_id"] for r in keep_identified(mixed).collect()} == want


def test_limits_hold_for_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, unseen = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    profiles = train_profiles(seen)
    limits = train_limits(seen, profiles)
    assert identify_languages(unseen, profiles, limits=limits).where("accepted").count() >= 0.99 * unseen.count()
    strange = spark.createDataFrame([(d, t) for d, t in FOREIGN.items()], "doc_id long, text string")
    assert identify_languages(strange, profiles, limits=limits).where("accepted").count() == 0


def test_odd_rows(odd, none, docs):
    profiles = train_profiles(docs)
    assert identify_languages(odd, profiles).count() == odd.count()
    kept = keep_identified(odd, profiles)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(3) == 2 and 6 not in ids and 4 not in ids and 9 not in ids
    assert identify_languages(odd).count() == odd.count()
    assert identify_languages(none).count() == 0 and keep_identified(none).count() == 0
