"""All operators and stages on odd rows, alone and beside columns of every name that their modules use."""

import inspect
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lodestone.llm import components, cotraining, embedding_dedup, license_scan, linear, mixing, ngram_join, packing, pii, quality_rules, sampling, substring_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Long text, 4111 1111 1111 1111 it's said. " * 70_000
ROWS = [
    (None, None, None, None, None), (None, "no id but words enough for a window of some size here", "en", "s", 53), (1, None, "en", "s", None), (2, "", None, "s", 0), (3, " \n\t ", "en", None, 4),
    (4, "one", "en", "s", 3), (5, "twelve plain words stand in this text so that it is kept", "en", "s", 56), (6, "twelve plain words stand in this text so that it is kept", "en", "s", 56),
    (6, "twelve plain words stand in this text so that it is kept", "en", "s", 56), (7, "a@b.co or 2021-01-02 and some more words that are not of any note", "fr", "t", 64),
    (8, LONG, "en", "t", len(LONG)), (9, "x" * 3_000_000, "en", "t", 3_000_000), (10, "é ü ß あ \U0001f600 licensed under the MIT license all rights reserved", "de", "u", 60), (7, "another text of an id that is there", "en", "t", 35),
]
LABELS = [(d, d % 2, int(d % 3 == 0)) for d in range(1, 9)] + [(None, 1, 1), (4, None, None), (5, 0, 1), (5, 1, 0)]

SHARED = (sampling, components, linear)


def vectors(spark):
    rows = [(None, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [1.0, 0.1], None)]
    rows += [(7, [1.0, 0.1], 1), (8, [1.0, 0.1], 1), (8, [1.0, 0.1], 1), (9, [1.0, 0.11], 1), (10, [1.0, 0.1], 2), (11, [1.0] * 20_000, 1), (11, [0.0, 1.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": (substring_dedup, lambda d, s: substring_dedup.remove_repeated_spans(d)),
    "op2": (embedding_dedup, lambda d, s: embedding_dedup.near_duplicates(d)),
    "op3": (license_scan, lambda d, s: license_scan.scan(d)),
    "op4": (quality_rules, lambda d, s: quality_rules.judge(d)),
    "op4_clean": (quality_rules, lambda d, s: quality_rules.clean(d, min_docs=1, max_share=0.1)),
    "op5": (cotraining, lambda d, s: cotraining.classify(d, cotraining.train(d, labels(s)))),
    "op6": (pii, lambda d, s: pii.replace_pii(d, b"key")),
    "op6_plain": (pii, lambda d, s: pii.replace_pii(d, b"key", spans_as=None)),
    "op7": (toxicity, lambda d, s: toxicity.classify(d, toxicity.train(d, labels(s)))),
    "op8": (mixing, lambda d, s: mixing.mix(d, labels(s))),
    "op8_resample": (mixing, lambda d, s: mixing.resample(d, labels(s))),
    "op9": (packing, lambda d, s: packing.pack(d)),
    "op10": (ngram_join, lambda d, s: ngram_join.join(d)),
    "op10_deduplicate": (ngram_join, lambda d, s: ngram_join.deduplicate(d)),
}
STAGES = {f"stage_{name}": (corpus_pipeline, lambda d, s, stage=stage: stage(s, d, "/root/testdata/sf0.001")) for name, stage in corpus_pipeline.STAGES}


def used_names(module, own):
    """Every name that stands in quotes in the module or in what it shares with others."""
    text = "".join(inspect.getsource(m) for m in (module, *SHARED))
    found = {n.lower(): n for n in re.findall(r"""["'`]([A-Za-z_]\w{0,30})["'`]""", text)}
    found |= {n.lower(): n for s in re.findall(r'"([^"\n]*)"', text) for n in re.findall(r"[A-Za-z_]\w{0,30}", s) if len(s) < 400}
    return [n for low, n in sorted(found.items()) if low not in own]


def shown(df, columns):
    return sorted(str([getattr(r, "__getitem__")(c) for c in columns])[:4000] for r in df.collect())


@pytest.mark.parametrize("name", [*OPERATORS, *STAGES])
def test_odd_rows_and_clashing_columns(spark, name):
    module, run = {**OPERATORS, **STAGES}[name]
    given = vectors(spark) if name == "op2" else spark.createDataFrame(ROWS, DOCS).repartition(3)
    plain = run(given, spark)
    columns = plain.columns
    want = shown(plain, columns)
    per_row = {"op1", "op2", "op3", "op4", "op5", "op6", "op6_plain", "op7", "op8", "op10", "stage_pii"}
    assert name not in per_row or len(want) == given.count()
    own = {c.lower() for c in given.columns}
    clashing = given.select("*", *(F.lit(i).alias(n) for i, n in enumerate(used_names(module, own))))
    assert len(clashing.columns) > len(given.columns) + 10
    out = run(clashing, spark)
    if columns[: len(given.columns)] == given.columns:
        # documents pass through with all their columns; added ones come last
        assert out.columns[: len(clashing.columns)] == clashing.columns
        added = columns[len(given.columns) :]
        out = out.select(*given.columns, *out.columns[len(clashing.columns) :]).toDF(*given.columns, *added)
    assert shown(out, columns) == want
    assert run(clashing.limit(0), spark).collect() == []
