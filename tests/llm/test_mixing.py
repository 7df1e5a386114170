import numpy as np
import pytest
from test_toxicity import corpus

from lodestone.llm import mixing as m

MIDDLE = "/root/testdata/sf0.01"


def brute(n, p, targets, steps=4000):
    """Plain projected gradient on one machine."""
    base = n @ p
    goal = base.sum() * np.array(targets) / sum(targets)
    x = np.ones(len(n))
    for _ in range(steps):
        x = np.maximum(0, x - p @ ((((n * x) @ p) - goal) / base))
    return x, goal


def test_rates_reach_the_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([1.0, 0.3, 0.2], size=400)
    n = rng.integers(1, 500, size=400)
    rows = [(i, i, int(n[i]), p[i].tolist()) for i in range(400)]
    members = spark.createDataFrame(rows, m._MEMBERS).repartition(3)
    steps, now, goal = m.solve(members, m.TARGETS)
    want, want_goal = brute(n, p, [0.9, 0.08, 0.02])
    x = m._rates(p, steps)
    assert goal == pytest.approx(want_goal) and (x >= 0).all()
    assert now == pytest.approx(((n * x) @ p))
    least = lambda x: float(np.sum((((n * x) @ p) - goal) ** 2 / (n @ p)))
    assert least(x) <= least(want) + 1e-3 * least(np.ones(400))


def test_whole_table(spark):
    rows = m.query(spark, MIDDLE).collect()
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    total = sum(r.n_tokens * r.rate for r in rows)
    clean = sum(r.n_tokens * r.rate * r.p_clean for r in rows) / total
    before = sum(r.n_tokens * r.p_clean for r in rows) / sum(r.n_tokens for r in rows)
    assert abs(clean - 0.9) < abs(before - 0.9) and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)
    truth = {r.doc_id: r for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    at = lambda r: max(("p_clean", "p_low", "p_toxic"), key=lambda k: r[k])
    hits = [at(r) == ("p_toxic" if truth[r.doc_id].toxic else "p_clean" if truth[r.doc_id].quality else "p_low") for r in rows if r.doc_id in truth]
    assert np.mean(hits) >= 0.9


def test_totals_of_the_whole_table(spark):
    """The rates reach every target, as a sum over the rows says; targets out of reach are told."""
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    rated, totals = m.mix_with_totals(docs, labels)
    rows = rated.collect()
    n, x = (np.array([r[c] for r in rows]) for c in ("n_tokens", "rate"))
    p = np.array([r.posteriors for r in rows])
    reached = (n * x) @ p
    goal = (n @ p).sum() * np.array([m.TARGETS[d] for d in m.DOMAINS])
    assert list(totals.reached.values()) == pytest.approx(reached) and list(totals.goal.values()) == pytest.approx(goal)
    assert np.abs(reached - goal).max() <= 1e-4 * goal.sum() and totals.steps < m.MAX_STEPS


def test_targets_out_of_reach(spark):
    """One document that is half of each domain: no rate gives nine to one; the steps end and the totals say so."""
    rows = [(1, 1, 100, [0.5, 0.5, 0.0])]
    members = spark.createDataFrame(rows, m._MEMBERS)
    steps, now, goal = m.solve(members, {"clean": 0.9, "low": 0.1})
    assert len(steps) < m.MAX_STEPS and now == pytest.approx([50, 50, 0], abs=1e-3) and goal == pytest.approx([90, 10, 0])


def test_resample_and_edges(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(d, t) for d, t, _, _ in rows] + [(None, None), (7, ""), (7, "")], "doc_id long, text string").selectExpr("*", "1 AS rate", "2 AS __x")
    labels = spark.createDataFrame([(d, 1, y) for d, _, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    mixed = m.mix(docs, labels)
    assert mixed.count() == 303 and {r.rate for r in mixed.where("n_tokens = 0").collect()} == {1.0}
    out = m.resample(docs, labels)
    assert out.columns == docs.columns
    wanted = {(r.doc_id, r.key): r.copies for r in mixed.collect()}
    got = out.where("doc_id IS NOT NULL AND text <> ''").groupBy("doc_id").count().collect()
    by_id = {d: c for (d, _), c in wanted.items() if d is not None}
    assert all(r["count"] == by_id[r.doc_id] for r in got if r.doc_id != 7)
    assert out.where("doc_id IS NULL").count() == 1
    assert m.mix(docs.limit(0), labels).count() == 0 and m.resample(docs.limit(0), labels).count() == 0
    assert {r.rate for r in m.mix(docs, labels.limit(0)).collect()} == {1.0}
