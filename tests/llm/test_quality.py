import numpy as np
from parlora.llm.quality import _sigmoid, calibrate, classify_quality, co_train, features, fit, fit_view
from parlora.llm.scratch import materialize


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen, held = labels.where("pmod(xxhash64(doc_id), 4) > 0"), labels.where("pmod(xxhash64(doc_id), 4) = 0")
    rows = classify_quality(docs, seen).join(held, "doc_id").collect()
    assert len(rows) > 60
    assert sum(r["keep"] == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows)
    assert all(r["keep"] for r in rows if r["quality"] == 1) or sum(not r["keep"] for r in rows if r["quality"] == 1) <= 2


def test_views_exchange_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = co_train(materialize(features(docs)), labels, rounds=2, exchange=20)
    assert 0 < model.pseudo <= 2 * 2 * 2 * 20


def test_training_equals_plain_rounds(spark):
    """The same rounds over arrays: no table, no join, no limit."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    table = materialize(features(docs))
    got = {r["doc_id"]: r["p_quality"] for r in classify_quality(docs, labels, rounds=2, exchange=15, confidence=0.9).collect()}
    x = {r["doc_id"]: (np.array(r["content"], float), np.array(r["meta"], float)) for r in table.collect()}
    hashes = {r[0]: r[1] for r in table.selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    label = {r["doc_id"]: float(r["quality"] > 0) for r in labels.collect() if r["doc_id"] in x}
    known = sorted(label, key=lambda d: (hashes[d], d))
    tenth = {d: (hashes[d] >> 7) % 10 for d in known}
    parts = [[d for d in known if tenth[d] in k] for k in (range(4, 10), (0, 1), (2, 3))]
    train = [[(x[d][k], label[d]) for d in parts[0]] for k in (0, 1)]
    taken, pool = [set(), set()], [d for d in x if d not in label]

    def trained():
        views = []
        for k in (0, 1):
            view = fit_view(np.array([r[0] for r in train[k]]), np.array([r[1] for r in train[k]]))
            views.append(calibrate(view, np.array([x[d][k] for d in parts[1]]), np.array([label[d] for d in parts[1]])))
        pair = np.stack([views[k].logit(np.array([x[d][k] for d in parts[2]])) for k in (0, 1)], axis=1)
        return views, fit(pair, np.array([label[d] for d in parts[2]]), 1e-2)

    views, (weights, bias) = trained()
    for _ in range(2):
        p = [dict(zip(pool, _sigmoid(views[k].logit(np.array([x[d][k] for d in pool]))))) for k in (0, 1)]
        for source, target in ((0, 1), (1, 0)):
            for y in (0.0, 1.0):
                sure = {d: v if y else 1 - v for d, v in p[source].items()}
                best = sorted((d for d in pool if sure[d] >= 0.9 and d not in taken[target]), key=lambda d: (-sure[d], hashes[d], d))[:15]
                taken[target] |= set(best)
                train[target] += [(x[d][target], y) for d in sorted(best)]
        views, (weights, bias) = trained()
    assert taken[0] and taken[1]
    want = {d: _sigmoid(np.array([[views[0].logit(x[d][0][None])[0], views[1].logit(x[d][1][None])[0]]]) @ weights + bias)[0] for d in x}
    assert max(abs(got[d] - want[d]) for d in x) < 1e-6


def test_regression_finds_the_slope():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    w, b = fit(x, y, 1e-6)
    assert np.abs(w - [2, -1]).max() < 0.2 and abs(b - 0.5) < 0.2


def test_odd_rows(odd, none, spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = classify_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["p_quality"] <= 1 for r in rows)
    strange = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert classify_quality(odd, strange).count() == odd.count()
    mixed = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    assert classify_quality(mixed, labels).count() == mixed.count()
    assert classify_quality(none, labels).count() == 0
    assert classify_quality(odd, labels.limit(0)).count() == odd.count()
