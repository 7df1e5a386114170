"""Licence scan with a positional rare-token index; DataFrame functions only.

1. One pass over the texts gives the base figures, the licence words that each file holds, and their positions
   in files that hold all mandatory words of some template.
2. Document frequencies of the licence words over the whole corpus give IDF weights.
3. Index: of every template the `RARE` words of highest IDF with their positions, and the rarest mandatory word
   where none is among them.  A file looks all of them up, however many it holds.
4. Template postings and file positions meet by relative position (file position minus template
   position), so all hits of one copy of a notice share one offset.
5. A template is found where, at one offset, every word of the mandatory key phrases stands in
   its place.  The score is the IDF share of the key and index words that stand there.

The index is one row per template word, a bound that no corpus changes.  Copies of a notice
anywhere in a text count; text of a single repeated licence word is aggregated, never paired.

Defined results: null or empty text has no words, no labels and score 0; null doc_ids
and repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import saved

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Word separators once A-Z are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: (label, notice, mandatory key phrases); notices as words.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "this software and associated documentation files")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0", ("cc0 1 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms", "with or without modification are permitted")),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
)

RARE = 4


def _key_places(notice: str, phrases: tuple[str, ...]) -> set[int]:
    words, places = notice.split(), set()
    for phrase in phrases:
        own = phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
        places |= set(range(at, at + len(own)))
    return places


def _template_words() -> list[tuple[int, str, int, str, bool]]:
    """(template, label, position, word, mandatory)."""
    out = []
    for t, (label, notice, phrases) in enumerate(TEMPLATES):
        keys = _key_places(notice, phrases)
        out += [(t, label, i, w, i in keys) for i, w in enumerate(notice.split())]
    return out


def spaced(text: Column) -> Column:
    """Words lower-cased in A-Z, each between two spaces of its own; null is empty."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(low, BREAKS, "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _count_words(part: Column) -> Column:
    """Words in a stretch of spaced text: each has two spaces of its own."""
    return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")


def _idf(figures: DataFrame, known: list[str]) -> dict[str, float]:
    """IDF of every template word over all documents; one number per template word reaches the driver."""
    rows = figures.select(F.explode(F.array_append("held", F.lit(""))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()
    df = {r.word: r.df for r in rows}
    total = df.get("", 0)
    return {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1e-6 for w in known}


def _index(idf: dict[str, float]) -> list[tuple[str, int, str, int, int, int, float, float]]:
    """(word, template, label, position, key bit, index word?, weight, template's weight) of key and index words."""
    words = _template_words()
    rows = []
    for t in range(len(TEMPLATES)):
        own = [x for x in words if x[0] == t]
        rare = sorted({w for _, _, _, w, _ in own}, key=lambda w: (-idf[w], w))[:RARE]
        used = [x for x in own if x[4] or x[3] in rare]
        total = sum(idf[w] for _, _, _, w, _ in used)
        bit = 0
        for _, label, at, w, key in used:
            rows.append((w, t, label, at, 1 << bit if key else 0, int(w in rare), idf[w], total))
            bit += key
    return rows


def _words_of(names) -> Column:
    return F.array(*(F.lit(w) for w in sorted(names)))


def scan(docs: DataFrame) -> DataFrame:
    """Figures and labels of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    template_words = _template_words()
    known = sorted({w for _, _, _, w, _ in template_words})
    mandatory = {frozenset(w for t, _, _, w, key in template_words if key and t == k) for k in range(len(TEMPLATES))}

    text = docs.select("doc_id", F.xxhash64("text").alias("key"), spaced(F.col("text")).alias("spaced"))
    text = text.withColumn("words", F.split(F.trim("spaced"), "  ", -1)).withColumn("held", F.array_intersect(_words_of(known), "words"))
    possible = reduce(lambda a, b: a | b, (F.size(F.array_except(_words_of(keys), "held")) == 0 for keys in sorted(mandatory, key=sorted)))
    hits = F.when(
        possible,
        F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.cast("int").alias("pos"))), lambda x: F.array_contains(_words_of(known), x["word"])),
    )
    n_base, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    n_words = F.when(F.col("spaced") == "", F.lit(0).cast("long")).otherwise(_count_words(F.col("spaced")))
    for phrase, label in BASE:
        size = len(phrase.split())
        mark = F.lit(" " + "  ".join(phrase.split()) + " ")
        held = F.contains("spaced", mark)
        length = len(phrase) + size + 1
        n_base += F.when(held, ((F.length("spaced") - F.length(F.replace("spaced", mark, F.lit("")))) / length).cast("long")).otherwise(0)
        firsts.append(F.when(held, _count_words(F.substring_index("spaced", " " + "  ".join(phrase.split()) + " ", 1))))
        after = _count_words(F.substring_index("spaced", " " + "  ".join(phrase.split()) + " ", -1))
        lasts.append(F.when(held, n_words - after - size))
        labels.append(F.when(held, F.lit(label)))
    figures = saved(
        text.select(
            "doc_id", "key", n_words.alias("n_words"), n_base.alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
            F.array_sort(F.array_compact(F.array(*labels))).alias("base"), "held", hits.alias("hits"),
        ),
        "licence-figures",
    )
    index = _index(_idf(figures, known))
    postings = spark.createDataFrame(index, "word string, template int, label string, at int, bit long, rare int, weight double, total double")
    full = {t: sum(r[4] for r in index if r[1] == t) for t in range(len(TEMPLATES))}
    masks = spark.createDataFrame(list(full.items()), "template int, mask long")
    postings = postings.join(F.broadcast(masks), "template")  # one row per template word
    placed = figures.where("size(hits) > 0").select("doc_id", "key", F.explode("hits").alias("h")).select("doc_id", "key", "h.word", "h.pos")
    met = placed.join(F.broadcast(postings), "word").select(
        "doc_id", "key", "template", "label", "mask", "at", "bit", "weight", "total", (F.col("pos") - F.col("at")).alias("offset"),
    )
    found = (
        met.groupBy("doc_id", "key", "template", "label", "mask", "total", "offset")
        .agg(F.bit_or("bit").alias("bits"), F.sum("weight").alias("got"))
        .where("bits = mask")
        .groupBy("doc_id", "key").agg(F.collect_set("label").alias("own"), F.max(F.least(F.lit(1.0), F.col("got") / F.col("total"))).alias("share"))
    )
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.key").eqNullSafe(F.col("b.key"))
    both = figures.alias("a").join(found.alias("b"), same, "left")
    return both.select(
        "a.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.round(F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))), 6).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    """The scan of `documents` as SQL, from the same templates."""
    words = ", ".join(f"({t}, '{label}', {at}, '{w}', {key})" for t, label, at, w, key in _template_words())
    base = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i - 1 AS i FROM d, range(1, len(w) + 1) r(i) WHERE list_contains(w, '{p.split()[0]}') AND w[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p, label in BASE
    )
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tw(t, label, place, word, mandatory) AS (VALUES {words}),
df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM tw) GROUP BY word),
idf AS (SELECT word, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(df, 0))) + 1e-6 AS weight FROM (SELECT DISTINCT word FROM tw) LEFT JOIN df USING (word)),
ranked AS (SELECT t, word, weight, row_number() OVER (PARTITION BY t ORDER BY weight DESC, word) <= {RARE} AS rare FROM (SELECT DISTINCT t, word FROM tw) JOIN idf USING (word)),
used AS (SELECT tw.*, weight, rare FROM tw JOIN ranked USING (t, word) WHERE mandatory OR rare),
total AS (SELECT t, sum(weight) AS total, count_if(mandatory) AS n_mandatory FROM used GROUP BY t),
pos AS (SELECT doc_id, word, i FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d) WHERE word IN (SELECT word FROM used)),
met AS (SELECT p.doc_id, u.t, u.label, p.i - u.place AS shift, u.mandatory, u.weight FROM pos p JOIN used u USING (word)),
found AS (SELECT doc_id, label, least(1.0, sum(weight) / any_value(total)) AS share FROM met JOIN total USING (t) GROUP BY doc_id, t, label, shift
  HAVING count_if(mandatory) = any_value(n_mandatory)),
own AS (SELECT doc_id, list(DISTINCT label) AS own, max(share) AS share FROM found GROUP BY doc_id),
place AS ({base}),
base AS (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM place GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(own, [])))), ',') AS labels,
  CAST(round(greatest(coalesce(share, 0.0), CASE WHEN n > 0 THEN 0.5 ELSE 0.0 END), 6) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""
