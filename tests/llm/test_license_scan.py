import re

from lodestone.llm import license_scan as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def places(w, phrase):
    p = phrase.split()
    return [i for i in range(len(w)) if w[i : i + len(p)] == p]


def brute(text):
    w = words(text)
    base = {label: places(w, phrase) for phrase, label in m.BASE}
    all_places = [i for x in base.values() for i in x]
    labels = {label for label, x in base.items() if x}
    own = set(labels)
    for label, notice, phrases in m.TEMPLATES:
        at = [places(notice.split(), p)[0] for p in phrases]
        first = [i - at[0] for i in places(w, phrases[0])]
        if any(all(w[o + a : o + a + len(p.split())] == p.split() and o + a >= 0 for a, p in zip(at, phrases, strict=True)) for o in first):
            own.add(label)
    return len(w), len(all_places), min(all_places, default=None), max(all_places, default=None), ",".join(sorted(labels)), ",".join(sorted(own))


def result(df):
    return [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)) for r in df.collect()]


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = m.query(spark, sf).collect()
    assert sorted(result(m.query(spark, sf))) == sorted((d, brute(t)) for d, t in rows)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got)


def test_edges(spark):
    texts = [None, "", "  \n", "CC BY cc by cc-by", "cc\x00by ccby", "General  PUBLIC, License all rights reserved. General public license", "é all rights reserved é", "mit " * 5000, "Released under the MIT License."]
    texts += ["the gnu general public license version 3 and gnu general public license, version 2", "cc by nc 4.0", " ".join(m.TEMPLATES[1][1].split()).title(), "license mit", "K all rights reserved", "reserved rights all", "x" * 100_000 + " All-Rights-Reserved"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "cc by"), (8, texts[8]), (8, "other text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS label", "'k' AS key")
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    assert sorted(result(m.scan(df)), key=key) == sorted(((d, brute(t)) for d, t in rows), key=key)


def test_several_notices(spark):
    notices = [notice for _, notice, _ in m.TEMPLATES]
    texts = [" end ".join(notices), ". ".join(reversed(notices)), " x ".join(notices[i] for i in (2, 11, 13, 12)), *notices]
    rows = [(i, f"{t} plain text") for i, t in enumerate(texts * 2)] + [(1000 + i, f"plain text {i}") for i in range(300)]
    got = m.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(result(got)) == sorted((d, brute(t)) for d, t in rows)
    assert brute(texts[0])[-1].count(",") == 16 and {r.score for r in got.where("doc_id = 0").collect()} == {1.0}


def test_key_phrase_of_common_words(spark):
    rows = [(i, "the mozilla public license v 2 0 alone") for i in range(40)] + [(100 + i, f"plain text {i}") for i in range(10)]
    assert sorted(result(m.scan(spark.createDataFrame(rows, "doc_id long, text string")))) == sorted((d, brute(t)) for d, t in rows)


def test_empty(spark):
    assert m.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python(spark, sf):
    plan = m.query(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
