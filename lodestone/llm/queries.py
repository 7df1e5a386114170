"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lodestone.llm import cotraining, embedding_dedup, license_scan, mixing, ngram_join, packing, pii, quality_rules, substring_dedup, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_embedding_dedup": embedding_dedup.query,
    "op3_license_scan": license_scan.query,
    "op4_quality_rules": quality_rules.query,
    "op5_cotraining": cotraining.query,
    "op6_pii": pii.query,
    "op7_toxicity": toxicity.query,
    "op8_mixing": mixing.query,
    "op9_packing": packing.query,
    "op10_ngram_join": ngram_join.query,
}

SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, range(1, len(w) - 48) t(i) WHERE len(w) >= 50),
lead AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h),
hit AS (SELECT doc_id, i FROM win JOIN lead USING (h) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(0, 50) t(k)),
removed AS (SELECT doc_id, count(*) AS n, list(i) AS places FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(places, j)), lambda j: w[j]), ' ') END) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id)
""",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND NOT list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, CAST((SELECT count(*) FROM link WHERE link.a = vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON comp.a = vec_id
""",
    "op3_license_scan": license_scan.sql(),
    "op4_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
line AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
normal AS (SELECT doc_id, host, text, line, len(lw) AS n, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM worded),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM worded GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT text) AS n_docs FROM d GROUP BY host),
counted AS (SELECT n.host, n.norm FROM (SELECT host, norm, count(DISTINCT text) AS seen FROM normal GROUP BY host, norm) n JOIN hosts USING (host) WHERE seen > 20 AND seen > n_docs * 0.1),
cut AS (SELECT doc_id, sum(n) AS n_cut FROM normal JOIN counted USING (host, norm) GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, range(1, len(w) - 3) t(i) WHERE len(w) >= 5),
twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_rep FROM win JOIN twice USING (doc_id, g), range(0, 5) t(k) GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_cut, 0) AS BIGINT) AS n_line_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN cut USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_line_words >= n_words * 0.5 AS kept, n_line_words FROM f
""",
    "op10_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
cls AS (SELECT w, min(doc_id) AS rep, count(*) AS weight FROM d WHERE len(w) > 0 GROUP BY w),
sh AS (SELECT DISTINCT rep, array_to_string(w[i:i + 4], ' ') AS s FROM cls, range(1, greatest(len(w) - 3, 2)) t(i)),
n AS (SELECT rep, count(*) AS n FROM sh GROUP BY rep),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.rep < b.rep GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE o >= 0.8 * (x.n + y.n - o) - 1e-9),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rep AS a, rep AS b FROM cls UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
linked AS (SELECT a AS rep, sum(c.weight) AS k FROM edge JOIN cls c ON c.rep = edge.b GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(k, 0) + coalesce(weight - 1, 0) AS BIGINT) AS n_links,
  coalesce(cls.rep, d.doc_id) AS text_id, coalesce(class_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN cls USING (w) LEFT JOIN comp ON comp.rep = cls.rep LEFT JOIN linked ON linked.rep = cls.rep
""",
}
