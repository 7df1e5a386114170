import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import toxicity as m

MIDDLE = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    got = {r.doc_id: r for r in m.query(spark, MIDDLE).collect()}
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    held = [(got[d].predicted, y) for d, y in truth.items() if got[d].held_out]
    hits = sum(p and y for p, y in held)
    assert hits / max(1, sum(p for p, _ in held)) >= 0.9 and hits / sum(y for _, y in held) >= 0.5


def corpus(n=900):
    rng = random.Random(4)
    bad = [f"foul{x}" for x in "abcdef"]
    rows = []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        y = int(i % 5 == 0)
        if y:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), ["en", "fr", None][i % 3], y))
    return rows


def test_fit_and_edges(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, x) for d, t, x, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1, y) for d, _, _, y in rows] + [(None, 1, 1), (3, None, None), (5, 0, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    model = m.train(docs, labels)
    more = [(1, None, None), (None, "", "en"), (7, "FOULA " * 20000, "fr"), (7, "w1 fouLb, w2", "fr"), (8, "w1 w2", "de"), (8, "w1 w2", "de")]
    odd = spark.createDataFrame(more, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS toxic")
    got = sorted([(str(r.doc_id), r.predicted) for r in m.classify(odd, model).collect()])
    assert got == [("1", 0), ("7", 1), ("7", 1), ("8", 0), ("8", 0), ("None", 0)]
    assert m.classify(docs.limit(0), model).collect() == []
    empty = m.train(docs, labels.limit(0))
    assert {r.score for r in m.classify(docs, empty).collect()} == {0.0}
    one = m.train(docs, labels.where("toxic = 0"))
    assert {r.score for r in m.classify(docs, one).collect()} == {0.0}


def test_pooling_is_the_convolution():
    rows = corpus(60)
    rows = [("a b", 0), ("", 1), ("x", 0)] + [(t, y) for _, t, _, y in rows]
    texts, y = pa.array([t for t, _ in rows]), np.array([y for _, y in rows])
    model = m.fit(texts, y, ["en"] * len(y), np.zeros(len(y), dtype=bool), epochs=1)
    words, stems, bounds = m.tokens(texts)
    got = model.pooled(words, stems, bounds)
    x = model.vectors[model.rows(words)] + model.vectors[model.rows(stems)]
    for d in range(len(y)):
        own, want = x[bounds[d] : bounds[d + 1]], []
        for width in m.WIDTHS:
            z = [sum(own[i + o] @ model.filters[width][o] for o in range(width) if i + o < len(own)) + model.biases[width] for i in range(len(own))]
            want.append(np.maximum(np.max(z, axis=0), 0) if z else np.zeros(m.FILTERS))
        assert got[d] == pytest.approx(np.concatenate(want), abs=1e-4)


def test_scores_one_by_one(spark):
    """Scores of the whole table are those of plain loops over each text."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = m.train(docs, labels)
    table = {int(h): v for h, v in zip(model.known, model.vectors[1:], strict=True)}
    zero = np.zeros(m.DIM)
    rows = docs.collect()
    got = {r.doc_id: r.score for r in m.classify(docs, model).collect()}
    for r in rows[::4]:
        words, stems, _ = m.tokens(pa.array([r.text]))
        x = [table.get(int(w), zero) + table.get(int(s), zero) for w, s in zip(words, stems, strict=True)]
        pooled = []
        for width in m.WIDTHS:
            z = [sum((x[i + o] @ model.filters[width][o] for o in range(width) if i + o < len(x)), start=np.zeros(m.FILTERS)) + model.biases[width] for i in range(len(x))]
            pooled += np.maximum(np.max(z, axis=0), 0).tolist() if z else [0.0] * m.FILTERS
        want = 1 / (1 + np.exp(-np.clip((np.array(pooled) @ model.weights + model.bias) * model.slope + model.shift, -40, 40)))
        assert got[r.doc_id] == pytest.approx(want, abs=1e-4)


def test_no_known_word(spark):
    """Labels of both classes, but no word in three rows: scores are constant and nothing fails."""
    docs = spark.createDataFrame([(i, f"only{i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert len({round(r.score, 6) for r in m.classify(docs, m.train(docs, labels)).collect()}) == 1


def test_sample_has_one_row_for_each_id(spark):
    from lodestone.llm.sampling import bounded_rows

    docs = spark.createDataFrame([(1, f"text {i}", "en") for i in range(500)] + [(2, "x" * 1000, "en"), (3, None, "en")], "doc_id long, text string, lang string")
    chosen = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (9, 1)], "doc_id long, toxic int")
    assert bounded_rows(docs, chosen).column("doc_id").to_pylist() == [1, 2, 3]
    assert bounded_rows(docs, chosen, max_bytes=100).column("doc_id").to_pylist() == [1, 3]


def many(spark, n=9600):
    """Short texts of more labels than 2,000 of class 1 and 4,000 of class 0; their words are rare."""
    rows = [(i, f"w{i % 1200} all{i % 7}" + " foul" * (i % 5 < 3), "en", int(i % 5 < 3)) for i in range(n)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    own = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    held = m.tk.mix(np.array([r[0] for r in own], dtype=np.int64).view(np.uint64)) % np.uint64(4) == 0
    return docs, labels, own, held


def test_learns_from_every_label(spark):
    """Known words, their odds and the thresholds are those of all rows that may be learnt, and the model does not depend on splits."""
    docs, labels, own, held = many(spark)
    assert len(own) > m.PART_ROWS
    model = m.train(docs.repartition(5), labels.repartition(3))
    texts, y = pa.array([r[1] for r in own]), np.array([r[3] for r in own], dtype=float)
    parts, taught = m.all_tokens(texts), np.flatnonzero(~held)
    known, count, toxic = m._known(m._gather(parts, taught), y[taught])
    assert model.known.tolist() == known.tolist() and count.min() == 3 and len(known) > 1000
    words = {}
    for r in (own[i] for i in taught):
        for w in set(r[1].split()):
            words.setdefault(w, []).append(r[3])
    by_hash = dict(zip(known.tolist(), zip(count.tolist(), toxic.tolist(), strict=True), strict=True))
    names = sorted(words)
    hashes, _, _ = m.tokens(pa.array([" ".join(names)]))
    assert {n: by_hash.get(h) for n, h in zip(names, hashes.tolist(), strict=True)} == {n: (len(v), sum(v)) if len(v) >= 3 else None for n, v in words.items()}
    check = np.flatnonzero(held)
    z = model.raw_score(*m._gather(parts, check)).astype(np.float64)
    again = m.Model(model.known, model.vectors)
    m._calibrate(again, z, y[check], np.array(["en"] * len(check), dtype=object))
    assert (model.slope, model.shift) == pytest.approx((again.slope, again.shift)) and model.lang_thresholds == pytest.approx(again.lang_thresholds)
    same = m.train(docs.coalesce(1), labels.coalesce(1))
    assert np.array_equal(same.vectors, model.vectors) and np.array_equal(same.weights, model.weights)
    assert (same.bias, same.slope, same.shift, same.lang_thresholds) == (model.bias, model.slope, model.shift, model.lang_thresholds)


def test_ids_too_many_to_broadcast(spark, monkeypatch):
    rows = corpus(300)
    docs = spark.createDataFrame([(d, t, x) for d, t, x, _ in rows] + [(None, "foula", "en"), (3, "w1 foula", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1, y) for d, _, _, y in rows], "doc_id long, quality int, toxic int")
    one = m.train(docs, labels)
    monkeypatch.setattr(m, "BROADCAST_IDS", 10)
    two = m.train(docs, labels)
    assert np.array_equal(one.known, two.known) and np.array_equal(one.vectors, two.vectors) and (one.slope, one.shift) == (two.slope, two.shift) and len(one.known) > 100


def test_an_epoch_is_the_mean_of_its_parts(spark):
    rows = corpus(300)
    texts, y = pa.array([t for _, t, _, _ in rows]), np.array([v for *_, v in rows], dtype=float)
    parts = m.all_tokens(texts)

    def fresh():
        model = m._start(*m._known(parts, y), len(y), int(y.sum()), np.random.default_rng(1))
        return model, {n: np.full(m._get(model, n).shape, 1e-4, dtype=np.float32) for n in m._SHARED} | {"e": np.full(model.vectors.shape, 1e-4, dtype=np.float32)}

    cuts, ends = [(0, 100), (100, 190), (190, 300)], []
    for a, b in cuts:
        model, memory = fresh()
        moved = set()
        for first in range(a, b, m.BATCH):
            pick = np.arange(first, min(b, first + m.BATCH))
            moved |= set(m._step(model, m._gather(parts, pick), y[pick], np.where(y[pick] == 1, 2.0, 0.5), 0.02, memory).tolist())
        ends.append((model, memory, moved))
    got, past = fresh()
    start = got.vectors.copy()
    table = spark.createDataFrame([(k, i, rows[i][1], rows[i][3]) for k, (a, b) in enumerate(cuts) for i in range(a, b)], "part long, place long, text string, toxic int")
    table = table.repartition(2, "part").sortWithinPartitions("part", "place").select("part", "text", "toxic")
    m._learn_once(table, got, past, (0.5, 2.0), 0.02)
    for name in m._SHARED:
        assert m._get(got, name) == pytest.approx(np.mean([m._get(e[0], name) for e in ends], axis=0), abs=1e-6)
        assert past[name] == pytest.approx(np.mean([e[1][name] for e in ends], axis=0), rel=1e-5)
    assert len(set().union(*(e[2] for e in ends))) > 10
    for row in range(len(start)):
        own = [e for e in ends if row in e[2]]
        assert got.vectors[row] == pytest.approx(np.mean([e[0].vectors[row] for e in own], axis=0) if own else start[row], abs=1e-6)


def test_words_that_share_a_slot_are_all_found(monkeypatch):
    monkeypatch.setattr(m, "SLOTS_BITS", 4)
    known = np.unique(np.random.default_rng(3).integers(0, 2**63, 400, dtype=np.int64).view(np.uint64) << np.uint64(1))
    model = m.Model(known, np.zeros((len(known) + 1, m.DIM), dtype=np.float32))
    assert model.rows(known).tolist() == list(range(1, len(known) + 1)) and not model.rows(known + np.uint64(1)).any()


def test_best_threshold():
    assert m.best_threshold(np.array([3.0, 2.0, 1.0]), np.array([1, 1, 0])) == 1.5
    assert m.best_threshold(np.array([1.0]), np.array([0])) is None


def test_lower_case():
    raw = np.frombuffer("ÀÞ×ß AZ é".encode(), dtype=np.uint8)
    assert m._lower(raw).tobytes().decode() == "àþ×ß az é"
