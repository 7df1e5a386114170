import random

from lodestone.llm import ngram_join as m
from lodestone.llm.components import components


def shingles(text):
    w = tuple((text or "").encode().split())
    return frozenset(w[i : i + 5] for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([w] if w else [])


def brute(rows, threshold=0.8):
    rows = sorted({(d, t or "") for d, t in rows if d is not None})
    sets = [shingles(t) for _, t in rows]
    links, root = {d: 0 for d, _ in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[rows[i][0]] += 1
                links[rows[j][0]] += 1
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return {d: (find(d), links[d]) for d, _ in rows}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect() if r.doc_id is not None}


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(m.query(spark, sf)) == brute(rows)


def corpus():
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(10)]
    for i in range(10, 120):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(40))) for i in range(30)]
    return rows + [(300, "a b"), (301, "a\tb"), (302, ""), (303, None), (304, "x " * 3000), (305, "x " * 5), (306, "  ")]


def test_edges_and_tiles(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([*rows, rows[0], (None, "a b"), (None, None)], "doc_id long, text string").selectExpr("*", "1 AS rep", "2 AS leader")
    assert result(m.join(df)) == brute(rows)
    monkeypatch.setattr(m, "TILE_ROWS", 16)
    assert result(m.join(df)) == brute(rows)
    assert sum(r.doc_id is None and r.kept and r.n_links == 0 for r in m.join(df).collect()) == 2


def test_deduplicate(spark):
    rows = corpus()
    want = sorted(d for d, (c, _) in brute(rows).items() if c == d)
    df = spark.createDataFrame([*rows, rows[0], (None, None)], "doc_id long, text string").selectExpr("*", "'e' AS __x")
    got = m.deduplicate(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == want


def bands(n=400):
    """Pairs of texts whose similarity lies in known bands, among strangers."""
    rng = random.Random(9)
    rows, i = [], 0
    for p in range(n):
        w = [f"p{p}x{k}" for k in range(200)]
        v = list(w)
        for k in range(1 + p % 4):
            v[20 + 45 * k] = f"new{p}"
        rows += [(i, " ".join(w)), (i + 1, " ".join(v[: 200 - 3 * (p % 9)]))]
        i += 2
    return rows + [(i + k, " ".join(f"z{rng.randrange(10**6)}" for _ in range(50))) for k in range(50)]


def test_recall_by_band(spark):
    rows = bands()
    want, of = brute(rows), dict(rows)
    found = {}
    got = result(m.join(spark.createDataFrame(rows, "doc_id long, text string")))
    for a in range(0, 800, 2):
        x, y = shingles(of[a]), shingles(of[a + 1])
        s = len(x & y) / len(x | y)
        if want[a][1]:
            found.setdefault(int(s * 20), []).append(got[a][1] == 1)
    assert len(found) >= 4 and min(found) == 16
    assert all(sum(x) / len(x) >= 0.999 for x in found.values()), found


def test_prefixes_shorten(spark, monkeypatch):
    """With few trees the recall measured at the longest prefixes is too low; shorter ones reach it."""
    rows, depths = bands(200), []
    profile = m._profile
    monkeypatch.setattr(m, "_profile", lambda trees, depth: depths.append(depth) or profile(trees, depth))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = result(m.join(df, trees=6, longest=12, target_recall=0.99)), brute(rows)
    assert depths == list(range(12, depths[-1] - 1, -1)) and 1 <= depths[-1] < 12
    assert sum(n for _, n in got.values()) >= 0.98 * sum(n for _, n in want.values())


def test_measured_recall():
    assert m.measured_recall(0, 0, 0) == 1 and m.measured_recall(100, 0, 0) == 1
    assert m.measured_recall(90, 20, 18) == 0.9


def test_texts_of_like_structure(spark):
    """Thue-Morse sequences and their complements link with nothing."""
    bits = [[bin(i).count("1") % 2 for i in range(n)] for n in (1024, 2048)]
    rows = [(10 * k + f, "".join("ab"[x ^ f] for x in b) + " tail") for k, b in enumerate(bits) for f in (0, 1)]
    rows += [(100 + 10 * k + f, " ".join(f"{'pq'[x ^ f]}{i // 9}" for i, x in enumerate(b))) for k, b in enumerate(bits) for f in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(m.join(df)) == brute(rows) and not any(n for _, n in result(m.join(df)).values())


def test_two_texts_of_one_id(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "x y z u v w"), (2, "a b c d e f")], "doc_id long, text string")
    assert {r.doc_id for r in m.deduplicate(df).collect()} == {1} and m.join(df).count() == 3


def test_components(spark):
    rng = random.Random(2)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    edges = [(a, b) for a, b in zip(chain, chain[1:], strict=False)] + [(1, i) for i in range(2, 40)] + [(7, 7), (50, 50), (60, 61), (60, 61)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(chain, 100), **dict.fromkeys(range(1, 40), 1), 60: 60, 61: 60}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.join(df).collect() == [] and m.deduplicate(df).collect() == []
