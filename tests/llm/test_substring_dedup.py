import hashlib
import random
import re

from lodestone.llm import substring_dedup as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, span):
    """The contract word by word: rows of (doc_id, text)."""
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - span + 1):
            k = tuple(w[i : i + span])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - span + 1):
            if d is not None and first[tuple(w[i : i + span])] < d:
                gone |= set(range(i, i + span))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=str)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(m.query(spark, sf)) == brute(rows, 50)


def check_factors(df, rows, span):
    """Factors cover the removed words, stand in their references and cannot be longer there."""
    words = {d: WORD.findall(t) for d, t in rows}
    n = 0
    for r in df.collect():
        own, at = words[r.doc_id], -1
        for first, many, ref, ref_first in r.factors:
            assert many >= span and first > at and ref < r.doc_id
            assert own[first : first + many] == words[ref][ref_first : ref_first + many]
            at = first
            n += 1
        assert {i for f in r.factors for i in range(f.first, f.first + f.n_words)} == {i for s in r.spans for i in range(s.first, s.last + 1)}
        assert len(own) - len(r.kept_text.split()) == r.n_removed
        # a factor ends where its words cease to stand in any first place that continues it
        for a, b in zip(r.factors, r.factors[1:]):
            continued = b.first == a.first + a.n_words - span + 1 and (b.ref_doc, b.ref_first) == (a.ref_doc, a.ref_first + a.n_words - span + 1)
            assert not continued
    return n


def test_factors(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    rows = [(1, " ".join(base[:900])), (2, " ".join(base[600:1500]))]
    rows += [(10 + i, " ".join(base[i * 40 : i * 40 + 300] + [f"own{i}"] + base[1000 + i * 20 : 1200 + i * 20])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for span in (8, 50):
        out = m.remove_repeated_spans(df, span=span)
        assert check_factors(out, rows, span) > 20
        assert result(out) == brute(rows, span)
    one = {r.doc_id: r for r in m.remove_repeated_spans(df, span=50).collect()}[10]
    # the first 300 words are one greedy factor in document 1
    assert tuple(one.factors[0]) == (0, 300, 1, 0)


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_passages_of_like_structure(spark):
    """Thue-Morse sequences and their complements share no long passage by any hash."""
    rows, d = [], 0
    for n in (1024, 2048):
        for flip in (0, 1):
            letters = "".join("ab"[x ^ flip] for x in thue_morse(n))
            for text in (" ".join(f"v{d}{i}" for i in range(60)) + " " + letters, " ".join("x y".split()[x ^ flip] * 40 for x in thue_morse(n))):
                rows.append((d, text))
                d += 1
    rows += [(90 + i, " ".join(["pq"[x ^ i] for x in thue_morse(64)])) for i in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(m.remove_repeated_spans(df)) == brute(rows, 50)


def test_edges(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(40)}" for _ in range(300)]
    rows = [(None, None), (None, " ".join(base)), (5, None), (5, ""), (6, " ".join(base)), (6, " ".join(base[:100])), (7, "\t".join(base[50:180]) + "\n")]
    rows += [(8, "a " * 200), (9, "a " * 120 + "b"), (3, " ".join(base[20:40] + base[60:90] + base[0:30])), (2, "ünï " * 60), (10, "x" * 100_000 + " ünï" * 60)]
    rows += [(20 + i, " ".join(base[rng.randrange(100) : rng.randrange(120, 300)] + ["z"] + base[: rng.randrange(100)])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'x' AS s1")
    for span in (4, 12, 50):
        assert result(m.remove_repeated_spans(df, span=span)) == brute(rows, span)


def test_spans_and_text(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x b c d y")], "doc_id long, text string")
    got = {r.doc_id: r for r in m.remove_repeated_spans(df, span=3).collect()}
    assert got[2].kept_text == "x y" and [tuple(s) for s in got[2].spans] == [(1, 3)]
    assert got[1].kept_text == "a b c d e" and got[1].spans == []


def test_empty(spark):
    assert m.remove_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_heads_and_tails(spark):
    """Every place of a difference inside blocks around one passage."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    rows = [(0, " ".join(base))]
    rows += [(i, " ".join(base[:i] + [f"other{i}"] + base[i + 1 :])) for i in range(1, 160, 3)]
    rows += [(200 + i, " ".join([f"a{i}.{k}" for k in range(30)] + base[i : i + 50 + i % 4] + [f"b{i}.{k}" for k in range(30)])) for i in range(0, 108, 2)]
    rows += [(-5, " ".join(base[40:95])), (2**40, " ".join(base[30:81])), (-(2**40), " ".join(base[100:150] + ["c"] * 130))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for span in (9, 11, 50):
        assert result(m.remove_repeated_spans(df, span=span)) == brute(rows, span)


def test_what_is_shuffled(spark):
    """Stock phrases shorter than a window lead to no lookups of single windows, and texts go through one exchange."""
    rng = random.Random(5)
    stock = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(12)) for _ in range(20)]
    rows = [(i, " ".join(rng.choice(stock) + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(10)) for _ in range(30))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = set(_written(spark))
    m.remove_repeated_spans(df, with_text=False).write.format("noop").mode("overwrite").save()
    assert 0 < sum(n for k, n in _written(spark).items() if k not in before) < 1.25 * sum(len(t) for _, t in rows)


def _written(spark):
    """Shuffled bytes of each stage."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    none = jvm.java.util.ArrayList()
    found = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}
