import re
from collections import Counter, defaultdict

import corpus_pipeline

from lodestone.llm import quality_rules as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs=20, max_share=0.1, min_left=0.5):
    seen, docs = defaultdict(set), defaultdict(set)
    lines = lambda t: [tuple(lower(y) for y in WORD.findall(x)) for x in (t or "").split("\n") if WORD.search(x)]
    for d, t, s in rows:
        docs[s or ""].add(t)
        for x in lines(t):
            seen[s or "", x].add(t)
    out = []
    for d, t, s in rows:
        b = base(t)
        gone = sum(len(x) for x in lines(t) if len(seen[s or "", x]) > min_docs and len(seen[s or "", x]) > max_share * len(docs[s or ""]))
        out.append((d, *b, gone, not b[-1] and b[0] - gone >= min_left * b[0]))
    return sorted(out, key=str)


def result(df):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "kept")
    return sorted([tuple(r) for r in df.select(*names).collect()], key=str)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(m.query(spark, sf)) == brute(rows)


def rows():
    out = [(i, f"own line {i} has a few more words of its own {i}\nThe  Common\tLine here\n" + ("again\nagain\n" if i % 3 else ""), "h1" if i % 2 else None) for i in range(60)]
    out += [(100 + i, "the common line HERE\n" + "z" * i, "h1") for i in range(10)]
    out += [(None, None, None), (5, "", "h2"), (5, None, "h1"), (6, "a b c d e f g h i j " * 50, "h2"), (7, "é ü # $ |<> \n\n é ü # $ |<> \n", "h1"), (8, "w" * 50000 + " x y", "h1")]
    return out + out[:3]


def test_edges(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string").selectExpr("*", "1 AS key", "2 AS host", "3 AS n_words")
    for limits in ({}, {"min_docs": 5, "max_share": 0.2, "min_left": 0.8}, {"min_docs": 0, "max_share": 0.0}):
        assert result(m.judge(df, **limits)) == brute(rows(), **limits)


def test_clean_removes_lines(spark):
    given = [(i, f"a b c d e f g h i j k {i}\nCommon line\nl m n o p q {i}", "s", i) for i in range(40)] + [(99, "too short", "s", 1), (None, None, None, None)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string, extra int")
    got = {r.doc_id: r for r in m.clean(df, min_docs=10, max_share=0.1).collect()}
    assert sorted(got) == list(range(40))
    assert got[7].text == "a b c d e f g h i j k 7\nl m n o p q 7" and got[7].extra == 7
    assert m.clean(df).columns == df.columns and {r.text for r in m.clean(df, max_share=2.0).collect()} == {x[1] for x in given[:40]}


def test_lines_of_large_hosts(spark):
    given = [(i, f"a b c d e f g h i j k {i}\n" + ("Common line\n" if i < 120 else "Rarer line\n" if i < 220 else "") + f"l m n o p q {i}", "s") for i in range(1500)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string")
    assert result(m.judge(docs)) == brute(given)
    got = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert got == {d: t.replace("Common line\n", "") for d, t, _ in given}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.judge(df).count() == 0 and m.clean(df).count() == 0
