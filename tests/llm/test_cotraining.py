import random

import numpy as np

from lodestone.llm import cotraining as m

MIDDLE = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    fewer = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in m.classify(docs, m.train(docs, fewer)).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.kept == (r.score >= m.CUT) for r in got.values())
    held = [(got[r.doc_id].kept, r.quality) for r in labels.where("doc_id % 2 = 1").collect()]
    assert np.mean([k == bool(q) for k, q in held]) >= 0.93
    assert np.mean([k for k, q in held if q == 1]) >= 0.97


def corpus(n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        y = int(i % 4 != 0)
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(20, 80))] if y else [rng.choice(["buy", "now", "w1"])] * 30
        rows.append((i, " ".join(words), "good" if y else "bad", "en", y))
    return rows


def test_views_exchange_labels(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(d, y, 0) for d, _, _, _, y in rows if d % 5 == 0] + [(None, 1, 1), (1, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = m.train(docs, labels)
    assert len(model.exchanged) == m.ROUNDS and all(model.exchanged)
    got = {r.doc_id: r.kept for r in m.classify(docs, model).collect()}
    assert np.mean([got[d] == bool(y) for d, _, _, _, y in rows]) >= 0.97
    odd = [(None, None, None, None), (1, "", "x", None), (1, "", "x", None), (2, "w1 " * 50000, "good", "en")]
    extra = spark.createDataFrame(odd, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS score", "2 AS quality")
    assert m.classify(extra, model).count() == 4 and m.classify(docs.limit(0), model).count() == 0
    none = m.train(docs, labels.limit(0))
    assert {r.score for r in m.classify(docs, none).collect()} == {0.5}
    one = m.train(docs, labels.where("quality = 1"))
    assert {r.score for r in m.classify(docs, one).collect()} == {1.0}


def test_calibration_and_balance():
    rng = np.random.default_rng(1)
    truth = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-truth))).astype(int)
    slope, shift = m.calibrate(truth * 4 + 2, y)
    assert abs(slope - 0.25) < 0.05 and abs(shift + 0.5) < 0.15
    assert m.balance([truth, rng.normal(size=4000)], y) > 0.8


def test_scores_one_by_one(spark):
    """Scores of the table are those of every text alone, by the two views' plain sums."""
    import pyarrow as pa

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = m.train(docs, labels)
    got = {r.doc_id: (r.score, r.content_score, r.metadata_score) for r in m.classify(docs, model).collect()}
    for r in docs.collect()[::5]:
        both = m.views(pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (r.text, r.source, r.lang)], names=["text", "source", "lang"]))
        z = []
        for softmax, x, (slope, shift) in zip(model.models, both, model.scaling, strict=True):
            total = np.clip((x.stats[0] - softmax.center) / softmax.scale, -5, 5) @ softmax.dense + softmax.bias
            if len(softmax.words) and len(x.buckets):
                total = total + sum(softmax.words[b].astype(np.float64) for b in x.buckets) / np.sqrt(len(x.buckets))
            z.append((total[1] - total[0]) * slope + shift)
        want = [model.weight * z[0] + (1 - model.weight) * z[1], *z]
        assert np.allclose(got[r.doc_id], 1 / (1 + np.exp(-np.clip(want, -40, 40))), atol=2e-4)


def test_pseudo_labels_come_from_all_documents(spark):
    """The surest rows are found wherever they stand, and none is given twice or has a label."""
    rows = corpus(600)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame([(d, y) for d, _, _, _, y in rows if d % 5 == 0], "doc_id long, quality int")
    model = m.train(docs, known.selectExpr("*", "0 AS toxic"))
    surest = m._chooser(m._plain(docs), known, 0.75)
    seen = []
    for _ in range(2):
        given = surest(model.models)
        z = [m.log_odds(mod, x) for mod, (x, _) in zip(model.models, [(g[0][v], 0) for v, g in enumerate(given)], strict=True)]
        for v, (_, t) in enumerate(given):
            assert len(t) and all((zz > 0) == bool(y) for zz, y in zip(z[v], t, strict=True))
        seen.append(sum(len(t) for _, t in given))
    assert all(seen)
