import numpy as np

from lodestone.llm import embedding_dedup as m


def brute(rows, threshold=0.93):
    good = []
    for v, e, label in rows:
        if v is not None and label is not None and e is not None and all(x is not None for x in e):
            a = np.array(e, dtype=np.float64)
            if np.isfinite(a).all() and a.any():
                good.append((v, label, a))
    ids = {v for v, _, _ in rows if v is not None}
    links, root = dict.fromkeys(ids, 0), {v: v for v in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(good)):
        for j in range(i):
            (v, a, x), (w, b, y) = good[i], good[j]
            if a == b and len(x) == len(y) and v != w and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[v] += 1
                links[w] += 1
                p, q = find(v), find(w)
                root[max(p, q)] = min(p, q)
    return {v: (links[v], find(v), find(v) == v) for v in ids}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect() if r.vec_id is not None}


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(m.query(spark, sf)) == brute(rows)


def cluster(dim, n=240):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(6, dim))
    rows = [(i, (centres[i % 6] + rng.normal(size=dim) * rng.choice([0.05, 0.25, 0.4])).tolist(), int(i % 12 < 6)) for i in range(n)]
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(20)]
    rows += [(2000, (np.array(rows[0][1]) * 7).tolist(), rows[0][2]), (2001, rows[0][1], None), (2002, [0.0] * dim, 1), (2003, None, 1), (2004, [], 1)]
    return rows + [(2005, [None, *rows[0][1][1:]], 1), (2006, [float("nan"), *rows[0][1][1:]], 1), (2007, [float("inf"), *rows[0][1][1:]], 1), (2008, [1.0, 2.0], 1), (2009, [2.0, 4.0], 1), (2010, [1e300, 2e300], 2), (2011, [1e-200, 2e-200], 2)]


def test_edges_and_tiles(spark, monkeypatch):
    for dim, tile, grid_blocks in ((8, 16, 4), (5, 1024, 2), (1, 50, 4), (33, 40, 8)):
        monkeypatch.setattr(m, "TILE", tile)
        rows = cluster(dim)
        rows = [r for r in rows if r[0] < 2010]
        df = spark.createDataFrame([*rows, rows[5], (None, rows[0][1], 1)], "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS task")
        for threshold in (0.93, 0.7):
            got = m.near_duplicates(df, threshold=threshold, blocks=(grid_blocks,))
            assert result(got) == brute(rows, threshold)


def test_labels_of_any_type(spark):
    rows = [(i, e, None if label is None else f"l{label}") for i, e, label in cluster(6, 60) if i < 2010]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    given = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert result(m.near_duplicates(df)) == brute(given)


def test_blocks_of_least_cost():
    """Random vectors meet at most once a pair; vectors with strong directions meet seldom."""
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(1000, 64))
    label = np.zeros(1000, dtype=int)
    met = lambda v: m.meetings(s := m.choose(v, label, 0.93), s.rotated(v), label, 0.14).sum()
    assert met(flat) <= 1.0
    steep = flat * np.where(np.arange(64) < 3, 30, 1)
    assert met(steep) < 0.4 * met(flat)
    for b in m.BLOCKS:
        split = m.Split.of(np.linalg.qr(flat[:64])[0], b)
        x, unit = split.rotated(flat), m._unit(flat)
        assert np.allclose(x @ x.T, unit @ unit.T) and np.array_equal(x[5:9], split.rotated(flat[5:9]))
        # pigeonhole: some block of a linked pair is within its share
        y = split.rotated(flat + 0.2 * rng.normal(size=flat.shape))
        near = ((x - y) ** 2).sum(1) <= 0.14
        parts = np.stack([((x - y) ** 2)[:, p:q].sum(1) for p, q in zip(split.bounds[:-1], split.bounds[1:])], axis=1)
        assert near.any() and (parts <= split.limits(0.14)).any(1)[near].all()


def test_empty(spark):
    assert m.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
