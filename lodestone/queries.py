"""The engine's queries over the test tables, and the same as SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.iri import normalise, resolve
from lodestone.operators.chase import ancestors, certain, chase, fact_text
from lodestone.operators.cores import VARIANTS, core
from lodestone.operators.homomorphism import to_cqs
from lodestone.operators.rewriting import rewrite
from lodestone.operators.ruleset import analyse, compile_rules, dependencies, strata
from lodestone.operators.union import UnionQuery
from lodestone.parser import parse
from lodestone.runtime import shared_dir
from lodestone.sources import files, views
from lodestone.sources.catalog import frame_source
from lodestone.sources.stores import StorageBuilder
from lodestone.syntax import Atom, Query
from lodestone.terms import Var

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "benchmark", "pages")

#: name: (query, answer columns, SQL)
PLAIN: dict[str, tuple[str, str, str]] = {
    "flagship_asia": ('?(CN, NN) :- customer(C, CN, N, Bal, Seg), nation(N, NN, R), region(R, "ASIA"), Bal > 5000.0.', "c_name n_name", "SELECT DISTINCT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 5000"),
    "atom_const": ("?(N) :- nation(K, N, 1).", "n_name", "SELECT DISTINCT n_name FROM nation WHERE n_regionkey = 1"),
    "cq_join2": ("?(CN, NN) :- customer(C, CN, N, B, S), nation(N, NN, R).", "c_name n_name", "SELECT DISTINCT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "cq_join3": ("?(CN, RN) :- customer(C, CN, N, B, S), nation(N, NN, R), region(R, RN).", "c_name r_name", "SELECT DISTINCT c_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "cq_join4": ("?(O, RN) :- orders(O, C, ST, P, D, PR), customer(C, CN, N, B, S), nation(N, NN, R), region(R, RN).", "o_orderkey r_name", "SELECT DISTINCT o_orderkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "cq_repeated_var": ("?(N) :- nation(K, N, K).", "n_name", "SELECT DISTINCT n_name FROM nation WHERE n_nationkey = n_regionkey"),
    "cq_equality_merge": ('?(X, Y) :- nation(K, X, R), region(S, Y), R = S, Y = "ASIA".', "n_name r_name", "SELECT DISTINCT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "cq_equality_conflict": ('?(X) :- nation(K, X, R), "a" = "b".', "n_name", "SELECT n_name FROM nation WHERE 1 = 0"),
    "cq_cross": ("?(X, Y) :- region(A, X), region(B, Y).", "x y", "SELECT DISTINCT a.r_name AS x, b.r_name AS y FROM region a, region b"),
    "cq_theta": ("?(X, Y) :- nation(A, X, R), nation(B, Y, R), A < B.", "x y", "SELECT DISTINCT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "cmp_lt": ("?(C) :- customer(C, N, K, B, S), B < 0.0.", "c_custkey", "SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal < 0"),
    "cmp_gt": ("?(C) :- customer(C, N, K, B, S), B > 9000.", "c_custkey", "SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 9000"),
    "cmp_le": ("?(O) :- orders(O, C, S, P, D, Y), P <= 2000.5.", "o_orderkey", "SELECT DISTINCT o_orderkey FROM orders WHERE o_totalprice <= 2000.5"),
    "cmp_ge": ('?(O) :- orders(O, C, S, P, D, Y), D >= "1997-06-01"^^xsd:date.', "o_orderkey", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-06-01'"),
    "cmp_ne": ('?(S) :- customer(C, N, K, B, S), S != "BUILDING".', "c_mktsegment", "SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "cmp_incomparable": ('?(N) :- nation(K, N, R), N < 5.', "n_name", "SELECT n_name FROM nation WHERE 1 = 0"),
    "cq_boolean": ("?() :- orders(O, C, S, P, D, Y), P > 1000.0.", "ok", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000) AS ok"),
    "cq_star": ("?(*) :- region(K, N).", "k n", "SELECT DISTINCT r_regionkey AS k, r_name AS n FROM region"),
    "exists_project": ("?(CN) :- customer(C, CN, N, B, S), orders(O, C, ST, P, D, PR).", "c_name", "SELECT DISTINCT c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "or_two_sources": ("?(N) :- customer(C, A, N, B, S) | supplier(U, V, N, W).", "nation", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier"),
    "or_nested": ('?(N) :- nation(K, N, R), (region(R, "ASIA") | region(R, "EUROPE"), K > 10).', "n_name", "SELECT DISTINCT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR (r_name = 'EUROPE' AND n_nationkey > 10)"),
    "ucq_three": ("?(X) :- region(K, X) | nation(A, X, B) | customer(C, D, E, F, X).", "name", "SELECT r_name AS name FROM region UNION SELECT n_name FROM nation UNION SELECT c_mktsegment FROM customer"),
    "not_safe": ('?(C) :- customer(C, CN, N, B, S), not (orders(O, C, ST, P, D, PR), D >= "1997-01-01"^^xsd:date, D < "1997-07-01"^^xsd:date).', "c_custkey", "SELECT DISTINCT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-07-01')"),
    "not_nested": ('?(C) :- customer(C, CN, N, B, S), not (orders(O, C, ST, P, D, PR), not (P > 100000.0)).', "c_custkey", "SELECT DISTINCT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > 100000)"),
    "difference": ("?(D) :- documents(D, T, L, S, N), not labels(D, Q, X).", "doc_id", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"),
    "intersect_cq": ("?(N) :- customer(C, A, N, B, S), supplier(U, V, N, W).", "nation", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "forall_relativised": ("?(RN) :- region(R, RN), not (nation(N, NN, R), not customer(C, CN, N, B, S)).", "r_name", "SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey))"),
    "fn_arith": ("?(O, L, V) :- lineitem(O, P, S, L, Q, E, D, T, RF, LS, SD), V = E * (1 - D).", "l_orderkey l_linenumber v", "SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS v FROM lineitem"),
    "fn_power_divide": ("?(K, V, W) :- part(K, N, B, T, Z, P), V = Z ** 2, W = Z / 4.", "p_partkey v w", "SELECT DISTINCT p_partkey, CAST(p_size AS BIGINT) * p_size AS v, p_size / 4.0::DOUBLE AS w FROM part"),
    "fn_divide_by_zero": ("?(K, V) :- nation(K, N, R), V = 12 / R.", "n_nationkey v", "SELECT DISTINCT n_nationkey, 12::DOUBLE / n_regionkey AS v FROM nation WHERE n_regionkey <> 0"),
    "fn_solve": ("?(K, A) :- nation(K, N, R), stdfct:sum(A, K, 30).", "n_nationkey a", "SELECT DISTINCT n_nationkey, CAST(30 - n_nationkey AS BIGINT) AS a FROM nation"),
    "fn_solve_product": ("?(K, A) :- nation(K, N, R), stdfct:product(K, A, 24), K > 0.", "n_nationkey a", "SELECT DISTINCT n_nationkey, CAST(24 // n_nationkey AS BIGINT) AS a FROM nation WHERE n_nationkey > 0 AND 24 % n_nationkey = 0"),
    "fn_string": ('?(K, L, U, N, R, C) :- nation(K, X, Y), stdfct:toLowerCase(X, L), stdfct:toUpperCase(L, U), stdfct:length(X, N), stdfct:replace(X, "NATION_", "n", R), stdfct:concat(R, L, C), stdfct:contains(X, "1", true).', "n_nationkey low up len short both", "SELECT DISTINCT n_nationkey, lower(n_name) AS low, upper(n_name) AS up, CAST(length(n_name) AS BIGINT) AS len, replace(n_name, 'NATION_', 'n') AS short, replace(n_name, 'NATION_', 'n') || lower(n_name) AS \"both\" FROM nation WHERE contains(n_name, '1')"),
    "fn_numeric_pred": ("?(K, E, O, P) :- part(K, N, B, T, Z, C), stdfct:isEven(K, E), stdfct:isOdd(K, O), stdfct:isPrime(Z, P).", "p_partkey even odd prime", "SELECT DISTINCT p_partkey, p_partkey % 2 = 0 AS even, p_partkey % 2 <> 0 AS odd, p_size > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 60) t(d) WHERE d < p_size AND p_size % d = 0) AS prime FROM part"),
    "fn_lex": ('?(N) :- nation(K, N, R), stdfct:isLexicographicallyGreaterThan(N, "NATION_2", true).', "n_name", "SELECT DISTINCT n_name FROM nation WHERE n_name > 'NATION_2'"),
    "fn_collection": ("?(K, Z, S) :- nation(K, N, R), stdfct:set(K, R, 3, U), stdfct:tuple(R, 7, V), stdfct:union(U, V, W), stdfct:size(W, Z), stdfct:sum(W, S).", "n_nationkey size total", "SELECT DISTINCT n_nationkey, CAST(len(list_distinct([n_nationkey, n_regionkey, 3, 7])) AS BIGINT) AS size, CAST(list_sum(list_distinct([n_nationkey, n_regionkey, 3, 7])) AS BIGINT) AS total FROM nation"),
    "fn_dict": ('?(K, V, H) :- nation(K, N, R), stdfct:dict(stdfct:tuple("name", N), stdfct:tuple("kind", "nation"), D), stdfct:get(D, "name", V), stdfct:containsKey(D, "kind", H).', "n_nationkey v has", "SELECT DISTINCT n_nationkey, n_name AS v, TRUE AS has FROM nation"),
    "fn_stat": ("?(K, A, M) :- nation(K, N, R), stdfct:average(K, R, 4, A), stdfct:median(K, R, 4, 9, M).", "n_nationkey a m", "SELECT DISTINCT n_nationkey, (n_nationkey + n_regionkey + 4) / 3.0::DOUBLE AS a, list_median([n_nationkey, n_regionkey, 4, 9])::DOUBLE AS m FROM nation"),
    "fn_weighted": ("?(K, A) :- nation(K, N, R), stdfct:weightedAverage(K, 1, R, 3, A).", "n_nationkey a", "SELECT DISTINCT n_nationkey, (n_nationkey * 1 + n_regionkey * 3) / 4.0::DOUBLE AS a FROM nation"),
    "fn_convert": ('?(K, I, F, B, S) :- nation(K, N, R), stdfct:replace(N, "NATION_", "", T), stdfct:toInt(T, I), stdfct:toFloat(T, F), stdfct:toBoolean(T, B), stdfct:toString(R, S), stdfct:isNumeric(T, true).', "n_nationkey i f b s", "SELECT DISTINCT n_nationkey, CAST(replace(n_name, 'NATION_', '') AS BIGINT) AS i, CAST(replace(n_name, 'NATION_', '') AS DOUBLE) AS f, replace(n_name, 'NATION_', '') NOT IN ('', 'false', '0') AS b, CAST(n_regionkey AS VARCHAR) AS s FROM nation"),
    "fn_least": ("?(K, A, B, M) :- nation(K, N, R), stdfct:min(K, R, 7, A), stdfct:max(K, R, 7, B), stdfct:weightedMedian(K, 1, R, 2, M).", "n_nationkey a b m", "SELECT DISTINCT n_nationkey, CAST(least(n_nationkey, n_regionkey, 7) AS BIGINT) AS a, CAST(greatest(n_nationkey, n_regionkey, 7) AS BIGINT) AS b, n_regionkey::DOUBLE AS m FROM nation"),
    "fn_minus": ("?(K, A, B) :- nation(K, N, R), stdfct:minus(K, R, 2, A), stdfct:divide(K, 8, B).", "n_nationkey a b", "SELECT DISTINCT n_nationkey, CAST(n_nationkey - n_regionkey - 2 AS BIGINT) AS a, n_nationkey / 8.0::DOUBLE AS b FROM nation"),
    "fn_power_exact": ("?(K, V) :- nation(K, N, R), stdfct:sum(R, 31, E), stdfct:power(3, E, V).", "n_nationkey v", "SELECT DISTINCT n_nationkey, CAST(list_reduce(list_transform(range(0, n_regionkey + 31), lambda i: 3::HUGEINT), lambda a, b: a * b) AS BIGINT) AS v FROM nation"),
    "fn_order": ("?(K, A, B, C, D, E) :- nation(K, N, R), stdfct:isGreaterThan(K, R, A), stdfct:isGreaterOrEqualsTo(K, R, B), stdfct:isSmallerThan(K, 3, C), stdfct:isSmallerOrEqualsTo(K, 3, D), stdfct:equals(K, R, E).", "n_nationkey a b c d e", "SELECT DISTINCT n_nationkey, n_nationkey > n_regionkey AS a, n_nationkey >= n_regionkey AS b, n_nationkey < 3 AS c, n_nationkey <= 3 AS d, n_nationkey = n_regionkey AS e FROM nation"),
    "fn_lex_order": ('?(N, A, B, C) :- nation(K, N, R), stdfct:isLexicographicallyGreaterOrEqualsTo(N, "NATION_2", A), stdfct:isLexicographicallySmallerThan(N, "NATION_2", B), stdfct:isLexicographicallySmallerOrEqualsTo(N, "NATION_2", C).', "n_name a b c", "SELECT DISTINCT n_name, n_name >= 'NATION_2' AS a, n_name < 'NATION_2' AS b, n_name <= 'NATION_2' AS c FROM nation"),
    "fn_blank": ('?(K, A, B, S) :- nation(K, N, R), stdfct:replace(N, "NATION_1", "", T), stdfct:isEmpty(T, A), stdfct:isBlank(T, B), stdfct:toStringWithDatatype(1, S).', "n_nationkey a b s", "SELECT DISTINCT n_nationkey, replace(n_name, 'NATION_1', '') = '' AS a, trim(replace(n_name, 'NATION_1', '')) = '' AS b, 'Literal<integer> 1' AS s FROM nation"),
    "fn_sets": ("?(K, Z, T, A, B, W) :- nation(K, N, R), stdfct:set(K, R, 3, U), stdfct:set(R, 3, V), stdfct:intersection(U, V, I), stdfct:size(I, Z), stdfct:toTuple(U, X), stdfct:size(X, T), stdfct:isSubset(V, U, A), stdfct:isStrictSubset(V, U, B), stdfct:toSet(stdfct:tuple(K, R, K), Y), stdfct:size(Y, W).", "n_nationkey z t a b w", "SELECT DISTINCT n_nationkey, CAST(len(list_distinct([n_regionkey, 3])) AS BIGINT) AS z, CAST(len(list_distinct([n_nationkey, n_regionkey, 3])) AS BIGINT) AS t, TRUE AS a, n_nationkey NOT IN (n_regionkey, 3) AS b, CAST(len(list_distinct([n_nationkey, n_regionkey])) AS BIGINT) AS w FROM nation"),
    "fn_dicts": ('?(K, Z, H, F, V) :- nation(K, N, R), stdfct:dict(stdfct:tuple("name", N), stdfct:tuple("kind", "old"), D), stdfct:dict(stdfct:tuple("kind", "new"), E), stdfct:mergeDicts(D, E, M), stdfct:dictKeys(M, Q), stdfct:size(Q, Z), stdfct:containsValue(M, N, H), stdfct:dictValues(M, W), stdfct:contains(W, "new", F), stdfct:get(M, "kind", V).', "n_nationkey z h f v", "SELECT DISTINCT n_nationkey, CAST(2 AS BIGINT) AS z, TRUE AS h, TRUE AS f, 'new' AS v FROM nation"),
    "anonymous_null": ("?(D) :- documents(D, _, _, S, _).", "doc_id", "SELECT DISTINCT doc_id FROM documents WHERE source IS NOT NULL"),
    "fn_nested_terms": ("?(K) :- nation(K, N, R), nation(K2, N2, R2), K2 = stdfct:sum(K, stdfct:product(R, 2)), R2 != R.", "n_nationkey", "SELECT DISTINCT a.n_nationkey FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + a.n_regionkey * 2 AND b.n_regionkey <> a.n_regionkey"),
}


def _plain(name: str) -> Callable[[SparkSession, str], DataFrame]:
    query, names, _ = PLAIN[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in TABLES if f"{t}(" in query]
        return Engine.over(spark, sf_dir, *used).ask(query, names.split())

    return run


def _rules(tables: str, rules: str, query: str, names: str, **options):
    """Chase, then ask."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine.over(spark, sf_dir, *tables.split())
        e.load(rules)
        return certain(e.saturated(**options).ask(query, names.split()))

    return run


def _rewritten(tables: str, rules: str, query: str, names: str, limit: int | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine.over(spark, sf_dir, *tables.split())
        e.load(rules)
        return e.ask_rewritten(query, names.split(), limit)

    return run


def _compiled(kind: str, tables: str, rules: str, query: str, names: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine.over(spark, sf_dir, *tables.split())
        e.load(rules)
        return e.ask_compiled(query, kind, names.split())

    return run


def _initial_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = Engine.over(spark, sf_dir, "nation", "customer").prepare("?(C, N) :- customer(C, CN, N, B, S), nation(N, NN, R).", ["c_custkey", "n_nationkey"])
    return prepared(spark.createDataFrame([(3,), (7,), (11,)], "N int"))


def _not_unsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    e.catalog.add("used", frame_source(nation.where("n_nationkey < 3").select("n_regionkey"))).add("reg", frame_source(region.select("r_regionkey")))
    return e.ask("?(X) :- not used(X).", ["r_regionkey"])


def _forall_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that reach every value of the domain, by a universal quantifier over it."""
    from lodestone.syntax import And, Atom, Exists, Forall, Query
    from lodestone.terms import Var

    e = Engine(spark)
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    pairs = region.selectExpr("r_regionkey AS a").crossJoin(region.selectExpr("r_regionkey AS b")).where("a <= 2 OR b < 3")
    e.catalog.add("near", frame_source(pairs))
    x, y = Var("X"), Var("Y")
    return e.ask(Query((x,), And((Exists((Var("Z"),), Atom("near", (x, Var("Z")))), Forall((y,), Atom("near", (x, y)))))), ["a"])


def _udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine.over(spark, sf_dir, "nation")

    def shifted(key: int, region: int) -> int:
        return key * 10 + region

    e.function("my:shifted", shifted)
    return e.ask("?(N, V) :- nation(K, N, R), my:shifted(K, R, V).", ["n_name", "v"])


def _udtf_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine.over(spark, sf_dir, "benchmark")

    def words(text: str) -> list[str]:
        return text.split(" ")

    e.function("my:words", words, many=True, returns="string")
    return e.ask("?(I, W) :- benchmark(I, T), my:words(T, W).", ["item_id", "word"])


def _udf_solver(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine.over(spark, sf_dir, "nation")

    def twice(x: int) -> int:
        return 2 * x

    def solve(x, y):
        return [(x, 2 * x)] if x is not None else [(y // 2, y)] if y % 2 == 0 else []

    e.function("my:twice", twice, solver=solve, min_bound=1)
    return e.ask("?(K, H) :- nation(K, N, R), my:twice(H, K).", ["n_nationkey", "half"])


def _view_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON web source declared by a view document; its answer is a folder of JSON lines."""
    path = _folder(spark, "json")
    given = F.from_json("props", "map<string,string>")
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_json(F.struct(F.col("event_id").alias("id"), given.alias("about")))).write.text(path)
    document = {
        "datasources": [{"id": "api", "protocol": "JSONWebAPI", "parameters": {"url": path, "lines": True}}],
        "views": [{"id": "prop", "datasource": "api", "query": "", "position": "$", "signature": [{"selection": "$.id", "type": "bigint"}, {"selection": "$.about.k", "type": "bigint", "ifMissing": "IGNORE"}]}],
    }
    e = Engine(spark)
    views.add_views(e.catalog, views.read_document(json.dumps(document)))
    return e.ask("?(E, K) :- prop(E, K), K < 50.", ["event_id", "k"])


def _views(spark: SparkSession, sf_dir: str, document: dict) -> Engine:
    e = Engine.over(spark, sf_dir, "nation")
    for t in ("customer", "labels", "documents"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"v_{t}")
    views.add_views(e.catalog, views.read_document(json.dumps(document)))
    return e


_SPARK = [{"id": "spark", "protocol": "SparkSQL", "parameters": {}}]


def _view_mandatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _views(spark, sf_dir, {"datasources": _SPARK, "views": [{"id": "holder", "datasource": "spark", "query": "SELECT c_nationkey, c_custkey FROM v_customer WHERE c_nationkey = %%n%%", "signature": [{"mandatory": "n"}, {}]}]})
    return e.ask("?(NN, C) :- nation(N, NN, 2), holder(N, C).", ["n_name", "c_custkey"])


def _view_missing(policy: str):
    query = "SELECT d.doc_id, l.quality FROM v_documents d LEFT JOIN v_labels l ON d.doc_id = l.doc_id"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shown = query if policy == "IGNORE" else query.replace("l.quality", "CAST(l.quality AS STRING) AS quality")
        e = _views(spark, sf_dir, {"datasources": _SPARK, "views": [{"id": "judged", "datasource": "spark", "query": shown, "signature": [{}, {"ifMissing": policy}]}]})
        out = e.ask("?(D, Q) :- judged(D, Q).", ["doc_id", "quality"])
        if policy in ("EXIST", "OPTIONAL"):
            return out.groupBy(F.col("quality.k").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("quality").alias("terms"))
        return out

    return run


def _federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine.over(spark, sf_dir, "nation")
    e.load('continent(0, africa), continent(1, america), continent(2, asia), continent(3, europe), continent(4, east).')
    return e.ask("?(N, C) :- nation(K, N, R), continent(R, C).", ["n_name", "continent"])


def _virtual_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine.over(spark, sf_dir, "nation")
    e.catalog.hide(("nation", 3), spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 3 = 0"))
    return e.ask("?(N) :- nation(K, N, R).", ["n_name"])


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    files.write_csv(spark.read.parquet(f"{sf_dir}/nation.parquet"), path)
    e = Engine(spark)
    files.add_csv(e.catalog, path, "nation")
    return e.ask("?(K, N) :- nation(K, N, R).", ["k", "n_name"])


def _rls_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest on the driver that names a CSV file; for local masters, where both are the same disk."""
    folder = Path(_folder(spark, "rls").removeprefix("file:"))
    folder.mkdir(parents=True)
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").collect()
    (folder / "regions.csv").write_text("".join(f"{r.r_regionkey},{r.r_name}\n" for r in rows), encoding="utf-8")
    (folder / "all.rls").write_text('@source reg[2]: load-csv("regions.csv").\n', encoding="utf-8")
    e = Engine(spark)
    files.add_manifest(e.catalog, str(folder / "all.rls"))
    return e.ask("?(N) :- reg(K, N).", ["r_name"])


def _rdf(mode: str, query: str, names: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine.over(spark, sf_dir, "nation")
        base = "concat('http://x/n', n_nationkey)"
        nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
        e.catalog = Engine(spark).catalog
        e.catalog.add("http://x/region", frame_source(nation.selectExpr(base, "concat('http://x/r', n_regionkey)")))
        e.catalog.add("http://x/Nation", frame_source(nation.selectExpr(base)))
        path = _folder(spark, "rdf")
        files.write_ntriples(files.as_triples(e.catalog), path)
        back = Engine(spark)
        files.add_rdf(back.catalog, files.read_ntriples(spark, path), mode)
        out = back.ask(query, names.split())
        return out.select(*(F.col(f"{c}.v").alias(c) for c in out.columns))

    return run


def _chase_count(checker: str):
    """How many facts a chase with existential heads creates."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine.over(spark, sf_dir, "nation", "customer")
        e.load("served(N, C) :- customer(C, A, N, B, S), B > 5000.0. served(N, Z) :- nation(N, X, R).")
        r = e.chase(checker=checker)
        return r.frame("served", 2).groupBy().agg(F.count(F.lit(1)).alias("n"))

    return run


def _violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine.over(spark, sf_dir, "customer", "nation")
    e.load("[poor] ! :- customer(C, N, K, B, S), B < 0.0. [rich] ! :- customer(C, N, K, B, S), B > 100000.0.")
    from lodestone.operators.chase import violations

    return spark.createDataFrame([(c.label, broken) for c, broken in violations(e.catalog, e.constraints)], "name string, broken boolean")


_TURNS = "conversations(V, T, R, X), conversations(V, U, Q, Y), U = T + 1"
_CHAIN = "step(V, T, U) :- conversations(V, T, R, X), conversations(V, U, Q, Y), U = T + 1. reach(V, T, U) :- step(V, T, U). reach(V, T, W) :- reach(V, T, U), step(V, U, W)."
_REACH_SQL = "SELECT DISTINCT a.conv_id, a.turn AS t, b.turn AS u FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE (SELECT count(DISTINCT c.turn) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn > a.turn AND c.turn <= b.turn) = b.turn - a.turn"
_GRAPH = "edge(A, B) :- nation(A, X, R), nation(B, Y, S), B = A + 5. "
_EDGES = "WITH RECURSIVE edge AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 5), reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a) "
_REACH = _GRAPH + "path(A, B) :- edge(A, B). path(A, C) :- path(A, B), edge(B, C)."
_TENS = _REACH.replace("A + 5", "A + 10")
_TENS_SQL = _EDGES.replace("+ 5", "+ 10")


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine.over(spark, sf_dir, "nation")
    e.load(_REACH)
    r = e.chase(lineage=True)
    goal = spark.range(1).select(fact_text("path", [F.lit(0), F.lit(20)]).alias("fact"))
    found = ancestors(r, goal, prime=False)
    return found.where(F.col("ancestor").startswith("edge(")).select(F.count(F.lit(1)).alias("n_edges"))


def _chase_held(checker: str, renamer: str):
    """How many facts a rule with an existential head creates for customers' nations."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine.over(spark, sf_dir, "customer")
        e.load("held(N, Z) :- customer(C, _, N, _, S).")
        return e.chase(checker=checker, renamer=renamer).frame("held", 2).groupBy().agg(F.count(F.lit(1)).alias("n"))

    return run


_SEATS_SQL = "SELECT (SELECT count(DISTINCT (s_nationkey, s_suppkey)) FROM supplier) + (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)) AS n"


def _chase_seats(**options):
    """Facts left where a null beside a known supplier folds onto it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine.over(spark, sf_dir, "nation", "supplier")
        e.load("seat(N, P) :- supplier(P, A, N, B). seat(N, Z) :- nation(N, X, R).")
        return e.chase(**options).frame("seat", 2).groupBy().agg(F.count(F.lit(1)).alias("n"))

    return run


def _external_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata given from outside."""
    e = Engine.over(spark, sf_dir, "customer", "nation")
    e.load("rich(N) :- customer(C, A, N, B, S), B > 9000.0. poor(N) :- nation(N, X, R), not rich(N).")
    return chase(e.catalog, e.rules, layers=[[e.rules[0]], [e.rules[1]]]).frame("poor", 1).select(F.col("c0").alias("n"))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine.over(spark, sf_dir, "customer", "nation")
    return spark.createDataFrame([(e.count("?(C, NN) :- customer(C, A, N, B, S), nation(N, NN, R)."),)], "n long")


def _estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine.over(spark, sf_dir, "customer", "nation", "region")
    bounds = [e.estimate(q) for q in ("?(C) :- customer(C, A, N, B, S), nation(N, NN, R), B > 0.0.", "?(X) :- nation(A, X, B) | region(C, X).", "?(C) :- customer(C, A, N, B, S), unknown(N).")]
    return spark.createDataFrame([tuple(bounds)], "joined long, united long, nothing long")


def _union_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with different answer variables, united by position."""
    e = Engine.over(spark, sf_dir, "customer", "supplier", "nation")
    parts = [UnionQuery.of(e.parse_query(q)) for q in ("?(N, A) :- customer(C, A, N, B, S).", "?(K, X) :- supplier(U, X, K, W).", "?(P, Q) :- nation(P, Q, R).")]
    return e.ask(parts[0] | parts[1] | parts[2], ["k", "n"])


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written twice to a SQLite store in the encoded layout and read by a query."""
    path = Path(_folder(spark, "store").removeprefix("file:"))
    path.parent.mkdir(parents=True, exist_ok=True)
    store = StorageBuilder().use_sqlite(f"{path}.db").layout("encoded").build(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    e = Engine(spark)
    e.catalog.store = store
    for rows in (nation.where("n_nationkey < 15"), nation):
        e.catalog.insert(("known place", 2), rows.select("n_nationkey", "n_name"))
    back = Engine(spark)
    back.catalog.store = store
    return back.ask(Query((Var("N"), Var("X")), Atom("known place", (Var("N"), Var("X")))), ["n", "name"])


def _turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Path(_folder(spark, "turtle").removeprefix("file:"))
    path.mkdir(parents=True)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    (path / "all.ttl").write_text("@prefix x: <http://x/> .\n" + "".join(f'x:n{r.n_nationkey} x:name "{r.n_name}" .\n' for r in rows), encoding="utf-8")
    e = Engine(spark)
    e.load_file(str(path / "all.ttl"))
    out = e.ask("?(S, O) :- <http://x/name>(S, O).", ["s", "o"])
    return out.select(F.col("s.v").alias("s"), F.col("o.v").alias("o"))


def _csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a header each, and rows that equal it."""
    path = _folder(spark, "headed")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("CAST(n_nationkey AS STRING) AS k", "n_name AS n")
    nation.repartition(3, "k").unionByName(nation).write.option("header", True).csv(path)
    e = Engine(spark)
    files.add_csv(e.catalog, path, "nation", files.CsvOptions(header_rows=1))
    return e.ask("?(K, N) :- nation(K, N).", ["k", "n"])


OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "cq_initial_binding": (_initial_binding, "SELECT DISTINCT c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey IN (3, 7, 11)"),
    "not_unsafe": (_not_unsafe, "SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation WHERE n_nationkey < 3"),
    "forall_adom": (_forall_domain, "WITH near AS (SELECT x.r_regionkey AS a, y.r_regionkey AS b FROM region x, region y WHERE x.r_regionkey <= 2 OR y.r_regionkey < 3) SELECT a FROM near GROUP BY a HAVING count(DISTINCT b) = (SELECT count(DISTINCT d) FROM (SELECT a AS d FROM near UNION SELECT b FROM near))"),
    "udf_scalar": (_udf_scalar, "SELECT DISTINCT n_name, CAST(n_nationkey * 10 + n_regionkey AS BIGINT) AS v FROM nation"),
    "udtf_multi": (_udtf_many, "SELECT DISTINCT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark"),
    "udf_solver": (_udf_solver, "SELECT DISTINCT n_nationkey, CAST(n_nationkey // 2 AS BIGINT) AS half FROM nation WHERE n_nationkey % 2 = 0"),
    "view_json": (_view_json, "SELECT DISTINCT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) < 50"),
    "view_mandatory": (_view_mandatory, "SELECT DISTINCT n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2"),
    "view_missing_ignore": (_view_missing("IGNORE"), "SELECT DISTINCT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL"),
    "view_missing_freeze": (_view_missing("FREEZE"), "SELECT DISTINCT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'judged_missing') AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "view_missing_exist": (_view_missing("EXIST"), "SELECT CASE WHEN l.quality IS NULL THEN 'n' ELSE 'c' END AS kind, count(*) AS n, CASE WHEN any_value(l.quality) IS NULL THEN count(*) ELSE count(DISTINCT l.quality) END AS terms FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"),
    "federated": (_federated, "SELECT DISTINCT n_name, ['africa', 'america', 'asia', 'europe', 'east'][n_regionkey + 1] AS continent FROM nation"),
    "virtual_delete": (_virtual_delete, "SELECT DISTINCT n_name FROM nation WHERE n_nationkey % 3 <> 0"),
    "csv_roundtrip": (_csv_roundtrip, "SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS k, n_name FROM nation"),
    "rls_load": (_rls_load, "SELECT DISTINCT r_name FROM region"),
    "rdf_raw": (_rdf("raw", "?(S, P, O) :- triple(S, P, O).", "s p o"), "SELECT 'http://x/n' || n_nationkey AS s, 'http://x/region' AS p, 'http://x/r' || n_regionkey AS o FROM nation UNION SELECT 'http://x/n' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://x/Nation' FROM nation"),
    "rdf_natural": (_rdf("natural", "?(S, O) :- <http://x/region>(S, O).", "s o"), "SELECT DISTINCT 'http://x/n' || n_nationkey AS s, 'http://x/r' || n_regionkey AS o FROM nation"),
    "rdf_natural_full": (_rdf("natural_full", "?(S) :- <http://x/Nation>(S).", "s"), "SELECT DISTINCT 'http://x/n' || n_nationkey AS s FROM nation"),
    "chase_datalog": (_rules("customer nation", "lives(C, R) :- customer(C, N, K, B, S), nation(K, M, R).", "?(C, R) :- lives(C, R).", "c_custkey n_regionkey"), "SELECT DISTINCT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "chase_tc": (_rules("conversations", _CHAIN, "?(V, T, U) :- reach(V, T, U).", "conv_id t u"), _REACH_SQL),
    "chase_tc_naive": (_rules("nation", _REACH, "?(A, B) :- path(A, B).", "a b", computer="naive", scheduler="naive"), _EDGES + "SELECT a, b FROM reach"),
    "chase_tc_two_step": (_rules("nation", _REACH, "?(A, B) :- path(A, B).", "a b", computer="two_steps"), _EDGES + "SELECT a, b FROM reach"),
    "chase_tc_grd": (_rules("nation", _REACH, "?(A, B) :- path(A, B).", "a b", scheduler="grd", applier="multi_thread"), _EDGES + "SELECT a, b FROM reach"),
    "chase_mutual": (_rules("nation", _GRAPH + "odd(A, B) :- edge(A, B). even(A, C) :- odd(A, B), edge(B, C). odd(A, C) :- even(A, B), edge(B, C).", "?(A, B) :- even(A, B).", "a b"), _EDGES.replace("SELECT a, b FROM edge UNION", "SELECT e.a, f.b FROM edge e JOIN edge f ON e.b = f.a UNION").replace("SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a", "SELECT r.a, f.b FROM reach r JOIN edge e ON r.b = e.a JOIN edge f ON e.b = f.a") + "SELECT a, b FROM reach"),
    "chase_stratified_neg": (_rules("nation", _TENS + " apart(A, B) :- nation(A, X, R), nation(B, Y, R), A < B, not path(A, B).", "?(A, B) :- apart(A, B).", "a b"), _TENS_SQL + "SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey EXCEPT SELECT a, b FROM reach"),
    "chase_step_limit": (_rules("nation", _REACH, "?(A, B) :- path(A, B).", "a b", max_steps=3, stratification="none"), "WITH edge AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 5) SELECT a, b FROM edge UNION SELECT e.a, f.b FROM edge e JOIN edge f ON e.b = f.a"),
    "chase_exist_count": (_chase_count("semi_oblivious"), "SELECT (SELECT count(DISTINCT (c_nationkey, c_custkey)) FROM customer WHERE c_acctbal > 5000) + (SELECT count(DISTINCT n_nationkey) FROM nation) AS n"),
    "chase_restricted_count": (_rules("nation customer", "served(N, C) :- customer(C, A, N, B, S), B > 9900.0. covered(N) :- served(N, C). open(N, Z) :- nation(N, X, R), not covered(N).", "?(N) :- open(N, Z).", "n", checker="restricted"), "SELECT n_nationkey AS n FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900"),
    "chase_function_head": (_rules("nation", "next(N, K + 1) :- nation(K, N, R). inverse(N, 12 / K) :- nation(K, N, R).", "?(N, J, I) :- next(N, J), inverse(N, I).", "n_name j i"), "SELECT DISTINCT n_name, CAST(n_nationkey + 1 AS BIGINT) AS j, 12::DOUBLE / n_nationkey AS i FROM nation WHERE n_nationkey <> 0"),
    "rewrite_hierarchy": (_rewritten("customer supplier", "party(N, K) :- customer(C, N, K, B, S). party(N, K) :- supplier(C, N, K, B). place(K) :- party(N, K).", "?(K) :- place(K).", "k"), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "rewrite_exist": (_rewritten("nation customer", "home(C, K) :- customer(C, N, K, B, S). inside(K, Z) :- home(C, K). at(Z) :- inside(K, Z).", "?(K) :- inside(K, Z), at(Z).", "k"), "SELECT DISTINCT c_nationkey AS k FROM customer"),
    "rewrite_disj": (_rewritten("nation", "green(K) | red(K) :- nation(K, N, R). good(K) :- green(K). good(K) :- red(K).", "?(K) :- good(K).", "k", 4), "SELECT DISTINCT n_nationkey AS k FROM nation"),
    "compiled_hier": (_compiled("hierarchical", "region", "place(K, N) :- region(K, N). spot(K, N) :- place(K, N).", "?(N) :- spot(K, N).", "n"), "SELECT DISTINCT r_name AS n FROM region"),
    "compiled_id": (_compiled("id", "nation region", "named(N, K) :- region(K, N). named(N, K) :- nation(K, N, R). pair(K, K) :- named(N, K).", "?(K) :- pair(K, K).", "k"), "SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation"),
    "constraint_violation": (_violation, "SELECT 'poor' AS name, EXISTS (SELECT 1 FROM customer WHERE c_acctbal < 0) AS broken UNION ALL SELECT 'rich', EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 100000)"),
    "lineage_ancestors": (_lineage, _EDGES + "SELECT count(*) AS n_edges FROM edge e WHERE (e.a = 0 OR EXISTS (SELECT 1 FROM reach r WHERE r.a = 0 AND r.b = e.a)) AND (e.b = 20 OR EXISTS (SELECT 1 FROM reach r WHERE r.a = e.b AND r.b = 20))"),
    "chase_oblivious_count": (_chase_held("oblivious", "body"), "SELECT count(*) AS n FROM (SELECT DISTINCT c_custkey, c_nationkey, c_mktsegment FROM customer)"),
    "chase_semi_oblivious_count": (_chase_held("semi_oblivious", "body"), "SELECT count(DISTINCT c_nationkey) AS n FROM customer"),
    "chase_frontier_count": (_chase_held("semi_oblivious", "frontier"), "SELECT count(DISTINCT c_nationkey) AS n FROM customer"),
    "chase_fresh_count": (_chase_held("so_restricted", "fresh"), "SELECT count(DISTINCT c_nationkey) AS n FROM customer"),
    "chase_piece_count": (_chase_held("semi_oblivious", "frontier_by_piece"), "SELECT count(DISTINCT c_nationkey) AS n FROM customer"),
    "chase_skolem_count": (_chase_held("semi_oblivious", "frontier_true"), "SELECT count(DISTINCT c_nationkey) AS n FROM customer"),
    "chase_equivalent": (_chase_seats(checker="equivalent"), _SEATS_SQL),
    "chase_core": (_chase_seats(core="end"), _SEATS_SQL),
    "chase_shared_body": (_rules("customer", "held(N, S), kind(S), at(N) :- customer(C, A, N, B, S). busy(N) :- customer(C, A, N, B, S).", "?(N, S) :- held(N, S), kind(S), at(N), busy(N).", "n s"), "SELECT DISTINCT c_nationkey AS n, c_mktsegment AS s FROM customer"),
    "chase_external_strata": (_external_strata, "SELECT n_nationkey AS n FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000"),
    "chase_atom_limit": (_rules("nation", _REACH, "?(A, B) :- edge(A, B).", "a b", max_atoms=30, stratification="none"), "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 5"),
    "answers_counted": (_counted, "SELECT count(*) AS n FROM (SELECT DISTINCT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"),
    "answers_estimated": (_estimated, "SELECT (SELECT count(*) FROM customer) * (SELECT count(*) FROM nation) AS joined, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS united, CAST(0 AS BIGINT) AS nothing"),
    "union_aligned": (_union_aligned, "SELECT c_nationkey AS k, c_name AS n FROM customer UNION SELECT s_nationkey, s_name FROM supplier UNION SELECT n_nationkey, n_name FROM nation"),
    "store_insert": (_stored, "SELECT n_nationkey AS n, n_name AS name FROM nation"),
    "rdf_turtle": (_turtle, "SELECT 'http://x/n' || n_nationkey AS s, n_name AS o FROM nation"),
    "csv_headers": (_csv_headers, "SELECT DISTINCT CAST(n_nationkey AS VARCHAR) AS k, n_name AS n FROM nation"),
}


def _chase_certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a derived predicate that hold no labelled null."""
    e = Engine.over(spark, sf_dir, "nation", "supplier")
    e.load("seat(N, P) :- supplier(P, A, N, B). seat(N, Z) :- nation(N, X, R).")
    rows = certain(e.chase().frame("seat", 2))
    return rows.select(F.col("c0").alias("n"), F.col("c1.v").cast("bigint").alias("p"))


OTHER["chase_certain"] = (_chase_certain, "SELECT DISTINCT s_nationkey AS n, s_suppkey AS p FROM supplier")


# algorithms over rules and queries, as tables of their verdicts
def _verdicts(columns: str, rows: Callable[[], list[tuple]]):
    """A small table of what an algorithm says."""
    return lambda spark, sf_dir: spark.createDataFrame(rows(), columns)


def _values(columns: str, rows: list[tuple]) -> str:
    """The rows that are expected, as SQL."""
    shown = lambda v: str(v).upper() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({columns})"


_CLASSES = [
    ("q(X) :- p(X,Y).", "linear guarded frontier_guarded range_restricted weakly_acyclic", ""),
    ("q(X,Z) :- p(X,Y), p(Y,Z).", "range_restricted weakly_acyclic weakly_sticky", "linear guarded frontier_guarded sticky"),
    ("p(Y,Z) :- p(X,Y).", "linear guarded sticky weakly_sticky", "range_restricted weakly_acyclic"),
    ("r(X,Y,Z) :- p(X,Y), q(Y,Z).", "sticky", "linear guarded"),
]
_LAYERED = "[p] p(Y,Z) :- p(X,Y). [q] q(X) :- p(X,X), not r(X). [r] r(X) :- s(X). [s] s(X) :- p(X,Y)."
#: Examples of RFC 3986, section 5.4.1, against http://a/b/c/d;p?q.
_RESOLVED = [
    ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"),
    ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), (";x", "http://a/b/c/;x"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("..", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"),
]
_NORMAL = [("case", "HTTP://User@Example.COM/A", "http://User@example.com/A"), ("percent", "http://a/%7e%c3", "http://a/~%C3"), ("path", "http://a/x/./y/../z", "http://a/x/z"), ("scheme", "HTTP://a:80", "http://a/"), ("string", "HTTP://a:80", "HTTP://a:80")]
_CONTAINED = [("?(X) :- p(X,Y), p(Y,Z).", "?(X) :- p(X,Y).", True), ("?(X) :- p(X,Y).", "?(X) :- p(X,Y), p(Y,Z).", False), ("?(X) :- p(X,Y), p(X,Z).", "?(X) :- p(X,Y).", True), ("?(X) :- p(X,Y).", "?(X) :- p(X,Y), p(X,Z).", True), ("?(X) :- p(X,X).", "?(X) :- p(X,Y), p(Y,X).", True)]
_FOLDED = [("p(a,b), p(a,X), p(X,Y), q(Y).", 4), ("p(a,X), p(a,Y), q(X), q(Y), r(Y).", 3), ("e(X,Y), e(Y,Z), e(Z,Z).", 1), ("p(a,b), q(b).", 2), ("e(X,Y), e(Y,X), e(A,B), e(B,C), e(C,A).", 5)]
_REWRITTEN = [("trades(N) :- party(N). party(N) :- customer(C, N). party(N) :- supplier(S, N). ?(N) :- trades(N).", 4), ("link(X, Z) :- base(X). ?(X) :- link(X, Y), base(X).", 1), ("link(X, Z) :- base(X). ?() :- link(X, a).", 1), ("good(X) :- green(X). good(X) :- red(X). green(X) | red(X) :- node(X). ?(X) :- good(X).", 4)]


def _classes() -> list[tuple]:
    return [(text, name, bool(analyse(parse(text).rules)[name])) for text, yes, no in _CLASSES for name in [*yes.split(), *no.split()]]


def _layers() -> list[tuple]:
    layers = strata(dependencies(parse(_LAYERED).rules), "minimal")
    return [(r.label, i) for i, layer in enumerate(layers) for r in layer]


def _graph() -> list[tuple]:
    found = parse(_LAYERED).rules
    return [(found[i].label, found[j].label, positive) for i, j, positive in dependencies(found).edges()]


def _containment() -> list[tuple]:
    one = lambda text: to_cqs(parse(text).queries[0])[0]
    return [(a, b, one(a).contained_in(one(b))) for a, b, _ in _CONTAINED]


def _rewritings() -> list[tuple]:
    out = []
    for text, _ in _REWRITTEN:
        doc = parse(text)
        out.append((text, len(rewrite(doc.queries[0], doc.rules, 6))))
    return out


def _unfolded() -> list[tuple]:
    found = compile_rules(parse("q(Y,X) :- p(X,Y). r(X) :- q(X,X). s(X,X) :- r(X). t(X) :- r(X), q(X,X).").rules)
    a, b = Var("A"), Var("B")
    return [(str(atom), str(x)) for atom in (Atom("q", (a, b)), Atom("r", (a,))) for x in found.unfold(atom)] + [("rest", str(len(found.rest)))]


ALGORITHMS: dict[str, tuple[str, Callable[[], list[tuple]], list[tuple]]] = {
    "rule_classes": ("rules string, name string, holds boolean", _classes, [(t, n, True) for t, yes, _ in _CLASSES for n in yes.split()] + [(t, n, False) for t, _, no in _CLASSES for n in no.split()]),
    "rule_strata": ("rule string, layer long", _layers, [("p", 0), ("r", 0), ("s", 0), ("q", 1)]),
    "rule_graph": ("rule string, other string, positive boolean", _graph, [("p", "p", True), ("p", "s", True), ("r", "q", False), ("s", "r", True)]),
    "rule_unfolding": ("atom string, entailing string", _unfolded, [("q(A, B)", "q(A, B)"), ("q(A, B)", "p(B, A)"), ("r(A)", "r(A)"), ("r(A)", "q(A, A)"), ("r(A)", "p(A, A)"), ("rest", "1")]),
    "query_containment": ("a string, b string, contained boolean", _containment, _CONTAINED),
    "query_rewritings": ("program string, n long", _rewritings, _REWRITTEN),
    "fact_cores": ("facts string, variant string, n long", lambda: [(t, v, len(core(parse(t).facts, v))) for t, _ in _FOLDED for v in VARIANTS], [(t, v, n) for t, n in _FOLDED for v in ("naive", "by_specialisation", "by_piece_exhaustive", "by_piece_deletion", "by_piece_specialisation", "by_piece_and_variable", "multi_thread")]),
    "iri_resolution": ("reference string, target string", lambda: [(r, resolve(r, "http://a/b/c/d;p?q")) for r, _ in _RESOLVED], _RESOLVED),
    "iri_normal_forms": ("kind string, iri string, normal string", lambda: [(k, t, normalise(t, k)) for k, t, _ in _NORMAL], _NORMAL),
}
for _name, (_schema, _rows, _expected) in ALGORITHMS.items():
    OTHER[_name] = (_verdicts(_schema, _rows), _values(", ".join(c.split()[0] for c in _schema.split(", ")), _expected))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**{n: _plain(n) for n in PLAIN}, **{n: f for n, (f, _) in OTHER.items()}}
SQL: dict[str, str] = {**{n: s for n, (_, _, s) in PLAIN.items()}, **{n: s for n, (_, s) in OTHER.items() if s}}
