import corpus_pipeline as m
from test_ngram_join import brute as classes
from test_packing import check
from test_quality_rules import brute as quality

from lodestone.llm import mixing
from lodestone.llm.pii import DEMO_KEY, Feistel, pseudonymise


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    kept = {x[0] for x in quality(given) if x[-1]}
    one = m.quality(spark, docs, sf).cache()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = m.near_duplicates(spark, one, sf).cache()
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(d for d, (c, _) in classes(rows).items() if c == d)
    three = m.personal_data(spark, two, sf).cache()
    fe = Feistel(DEMO_KEY)
    want = {r.doc_id: pseudonymise(fe, r.text)[0] for r in two.collect()}
    assert three.columns == docs.columns and {r.doc_id: r.text for r in three.collect()} == want
    assert all(r.n_chars == len(r.text) for r in three.collect())
    four = m.weights(spark, three, sf).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(three, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    got = {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert four.columns == docs.columns and got == {d: c for d, c in copies.items() if c}
    check([(r.doc_id, r.text) for r in four.collect()], m.sequences(spark, four, sf).collect(), 2048)


def test_run(spark, sf):
    got = m.run(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0


def test_stages_take_odd_rows(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c d e f g h i j k l", None, None, 23)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in m.STAGES:
            out = stage(spark, docs, sf)
            assert name == "packing" or out.columns == docs.columns
            out.collect()
