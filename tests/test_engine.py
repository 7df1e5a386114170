import json
import sqlite3

import pytest

from lodestone import cli
from lodestone.engine import Engine
from lodestone.operators.chase import CHECKERS, COMPUTERS, RENAMERS, MayNotTerminate, Options, ancestors, chase
from lodestone.operators.cores import collect, is_core
from lodestone.operators.homomorphism import equivalent_sets
from lodestone.parser import parse
from lodestone.plans.compiler import Compiler, UnsafeNegationWarning
from lodestone.plans.encoding import PlanError
from lodestone.sources import files, views
from lodestone.syntax import Atom, Exists, Forall, Query
from lodestone.terms import Const, Func, Null, Var


@pytest.fixture
def e(spark):
    return Engine(spark)


def answers(df):
    return sorted(tuple(str(getattr(v, "v", v)) for v in r) for r in df.collect())


def test_facts_and_queries(e):
    e.load('p(a,b), p(b,c), p(c,c). n(1), n(2). m(1), m("x"). w(a, X).')
    assert answers(e.ask("?(X) :- p(X,X).")) == [("c",)]
    assert answers(e.ask("?(X,Z) :- p(X,Y), p(Y,Z).")) == [("a", "c"), ("b", "c"), ("c", "c")]
    assert answers(e.ask("?(X) :- n(X), m(X).")) == [("1",)]
    assert answers(e.ask("?(X) :- p(X,Y), not p(Y,X).")) == [("a",), ("b",)]
    assert answers(e.ask("?(X) :- p(X,Y), unknown(Y).")) == [] and answers(e.ask("?(X) :- p(X,Y), not unknown(Y).")) == [("a",), ("b",), ("c",)]
    assert e.ask("?() :- p(a,b).").first().ok and not e.ask("?() :- p(b,a).").first().ok
    # labelled nulls join with themselves only
    assert answers(e.ask("?(X) :- w(X,Y), p(Y,Z).")) == []
    assert e.ask("?(Y) :- w(a,Y).").first().Y.k == "n"
    assert e.explain("?(X) :- n(X).")


def test_unsafe_negation_and_universal(e):
    e.load("p(a), p(b), q(a,a), q(a,b), q(b,a).")
    with pytest.warns(UnsafeNegationWarning):
        assert answers(e.ask("?(X) :- not q(X,X).")) == [("b",)]
    x, y = Var("X"), Var("Y")
    every = Query((x,), Exists((), Atom("p", (x,))))
    assert answers(e.ask(every)) == [("a",), ("b",)]
    from lodestone.syntax import And

    with pytest.warns(UnsafeNegationWarning):
        assert answers(e.ask(Query((x,), And((Atom("p", (x,)), Forall((y,), Atom("q", (x, y)))))))) == [("a",)]
    with pytest.raises(PlanError):
        Compiler(e.catalog, domain_cap=1).query(Query((x,), e.parse_query("?(X) :- not q(X,X).").body))


def test_writes(e, spark):
    e.load("p(a), p(b).")
    e.load("p(b), p(c).")
    assert e.catalog.count() == 3
    e.catalog.remove(("p", 1), spark.createDataFrame([("a",)], "c0 string"))
    assert answers(e.ask("?(X) :- p(X).")) == [("b",), ("c",)]
    e.catalog.add("r", spark.range(3))
    assert "read-only" in e.catalog.accepts(Atom("r", (Const("x"),))) and "arity" in e.catalog.accepts(Atom("p", (Const("x"), Const("y"))))
    assert "variable" in e.catalog.accepts(Atom("p", (Var("X"),))) and e.catalog.accepts(Atom("new", (Const("x"),))) is None
    with pytest.raises(TypeError):
        e.catalog.insert(("r", 1), spark.range(1))
    with pytest.raises(PlanError):
        e.catalog.add("p", spark.createDataFrame([("z",)], "c string"))
    e.catalog.default_sink = False
    with pytest.raises(KeyError):
        e.catalog.insert(("fresh", 1), spark.range(1))


KBS = {
    "chain": ("p(a,b), p(b,c).", "p(Y,X) :- p(X,Y). q(X,Y) :- p(X,Y). r(X,Y) :- q(X,Y)."),
    "exists": ("base(a), base(b).", "link(X,Y) :- base(X). tag(Y) :- link(X,Y)."),
    "conjunctive": ("node(a), node(b).", "left(X), right(X) :- node(X). done(X) :- left(X), right(X)."),
}
CONFIGS = [{"computer": c} for c in COMPUTERS] + [{"checker": c} for c in CHECKERS] + [{"renamer": r} for r in RENAMERS] + [{"scheduler": "grd"}, {"applier": "multi_thread"}, {"core": "end"}, {"split_rules": False}]


@pytest.mark.parametrize("kb", KBS)
def test_chase_variants_agree(spark, kb):
    facts, rules = KBS[kb]
    e = Engine(spark)
    e.load(facts + rules)
    want = collect(e.chase().catalog)
    for config in CONFIGS:
        found = collect(e.chase(**config, max_steps=8).catalog)
        if config.get("renamer", "").endswith("_true"):  # true skolem terms are nulls in another notation
            found = [Atom(a.pred, tuple(Null(str(t)) if isinstance(t, Func) else t for t in a.terms)) for a in found]
        assert equivalent_sets(found, want), config


def test_chase_parts_stay_few(spark):
    """A long chain: logarithmically many parts, all rows."""
    from lodestone.operators import chase as m

    e = Engine(spark)
    e.load("t(X,Y) :- e(X,Y). t(X,Z) :- e(X,Y), t(Y,Z).")
    e.catalog.add("e", spark.createDataFrame([(i, i + 1) for i in range(24)], "a int, b int"))
    seen, publish = [], m._Round.publish
    m._Round.publish = lambda self: (publish(self), seen.append(max(len(p) for p in self.parts.values())))
    try:
        r = e.chase()
    finally:
        m._Round.publish = publish
    assert r.frame("t", 2).count() == 24 * 25 // 2 and len(seen) >= 24 and max(seen) <= 5


def test_semi_naive_finds_no_trigger_twice(spark):
    """Anchored on new rows, with old rows behind the anchor: each pair of rows meets once."""
    from lodestone.operators import chase as m

    e = Engine(spark)
    e.load("t(X,Y) :- e(X,Y). t(X,Z) :- t(X,Y), t(Y,Z).")
    e.catalog.add("e", spark.createDataFrame([(i, i + 1) for i in range(8)], "a int, b int"))
    rows, heads = [], m._Round.heads
    m._Round.heads = lambda self, rule, rel, number, step: (rows.append((rule.label, rel.df.count())), heads(self, rule, rel, number, step))[1]
    try:
        r = e.chase(lineage=True)
    finally:
        m._Round.heads = heads
    # t(x,z) has one derivation for every y between x and z
    assert r.frame("t", 2).count() == 36 and sum(n for label, n in rows if label == "r1") == sum(z - x - 1 for x in range(9) for z in range(x + 2, 9))


def test_shared_bodies_run_once(spark):
    from lodestone.operators import chase as m

    e = Engine(spark)
    e.load("p(a,b), p(b,c). q(X,Y), r(Y), s(X) :- p(X,Y). u(Y) :- p(X,Y).")
    bodies, body = [], m._Round.body
    m._Round.body = lambda self, rule, *rest: (bodies.append(str(rule.body)), body(self, rule, *rest))[1]
    try:
        r = e.chase()
    finally:
        m._Round.body = body
    assert len(bodies) == 1
    assert [r.frame(n, k).count() for n, k in (("q", 2), ("r", 1), ("s", 1), ("u", 1))] == [2, 2, 2, 2]


def test_checkers_and_renamers_count(spark):
    """How many nulls each checker makes under renamers that tell bodies apart."""
    e = Engine(spark)
    e.load("p(a,b), p(a,c), p(d,b). h(a,k). h(X,Z) :- p(X,Y).")
    n = lambda **o: e.chase(**o).frame("h", 2).count() - 1
    assert n(checker="oblivious", renamer="body") == n(checker="oblivious", renamer="fresh") == 3
    assert n(checker="semi_oblivious", renamer="body") == n(checker="semi_oblivious", renamer="fresh") == n(checker="semi_oblivious") == 2
    assert n(checker="restricted") == n(checker="so_restricted", renamer="fresh") == n(checker="equivalent") == 1


def test_interruption_cancels_jobs(spark):
    import threading
    import time

    e = Engine(spark)
    e.load("p(1).")

    def slow(x: int) -> int:
        time.sleep(60)
        return x

    e.function("my:slow", slow)
    e.rules += parse("@computed my: <registered>.\nq(Y) :- p(X), my:slow(X,Y).").rules
    stop = threading.Event()
    threading.Timer(2.0, stop.set).start()
    began = time.monotonic()
    r = e.chase(stop=stop)
    assert r.stopped == "interrupted" and time.monotonic() - began < 45 and r.catalog.find(("q", 1)) is None
    assert '"interrupted"' in r.describe_json()


def test_federated_ancestors(spark):
    results = []
    for text in ("a(x). b(X) :- a(X).", "b(x). c(X) :- b(X)."):
        e = Engine(spark)
        e.load(text)
        results.append(e.chase(lineage=True))
    goal = results[1].derivations.select("head").toDF("fact")
    assert ancestors(results[1], goal).count() == 1 and ancestors(results, goal).count() == 2
    assert [r.ancestor[0] for r in ancestors(results, goal, prime=True).collect()] == ["a"]


@pytest.mark.parametrize("facts", ["p(a,b), p(a,X), p(Y,b), p(Z,W), q(c).", "p(X,X), p(Y,Z), p(U,V).", "p(X,Y), p(Z,W), q(X), q(a).", "p(a,X), p(a,Y), p(b,X), p(Z,Z), p(c,c).", "p(a,X), p(a,Y), q(X), q(Y), r(Y)."])
def test_catalog_cores(spark, facts):
    """Single facts fold by joins, larger pieces after them; what is left is a core of the same facts."""
    from lodestone.operators.cores import core, fold_catalog

    e = Engine(spark)
    e.load(facts)
    given = collect(e.catalog)
    gone = fold_catalog(e.catalog)
    left = collect(e.catalog)
    assert is_core(left) and equivalent_sets(left, given) and len(left) == len(core(given)) == len(given) - gone


def test_many_single_facts_fold_without_a_cap(spark):
    from lodestone.operators.cores import fold_catalog

    e = Engine(spark)
    e.load("seat(C, Z) :- guest(C). seat(C, P) :- place(C, P).")
    e.catalog.add("guest", spark.range(3000).selectExpr("cast(id AS int) AS c")).add("place", spark.range(1000).selectExpr("cast(id AS int) AS c", "cast(id * 2 AS int) AS p"))
    catalog = e.chase().catalog
    assert fold_catalog(catalog, cap=10) == 1000 and catalog.find(("seat", 2)).frame().count() == 3000


def test_chase_limits_and_core(spark):
    e = Engine(spark)
    e.load("p(a,b). p(Y,Z) :- p(X,Y). p(Y,Y) :- p(X,Y), p(Y,Z).")
    with pytest.raises(MayNotTerminate):
        e.chase()
    r = e.chase(max_steps=2, core="end")
    assert r.stopped == "step limit" and is_core(collect(r.catalog)) and {str(a) for a in collect(r.catalog)} == {"p(a, b)", "p(b, b)"}
    assert e.chase(max_atoms=2).stopped == "atom limit" and e.chase(timeout=0.0).stopped == "timeout"
    with pytest.raises(PlanError):
        chase(e.catalog, parse("a(X) | b(X) :- p(X,Y).").rules)
    with pytest.raises(ValueError):
        Options(computer="none")


def test_chase_negation_functions_lineage(spark):
    e = Engine(spark)
    e.load("e(a,b), e(b,c). v(a), v(b), v(c). t(X,Y) :- e(X,Y). t(X,Z) :- t(X,Y), e(Y,Z). last(X) :- v(X), not t(X,Y). num(3). next(X + 1) :- num(X). gone(X / 0) :- num(X).")
    r = e.chase(lineage=True, keep=frozenset(["t", "last", "next"]))
    assert answers(r.frame("last", 1)) == [("c",)] and answers(r.frame("next", 1)) == [("4",)] and "steps" in r.describe()
    goal = r.derivations.where("head LIKE 't(%a%c%'").selectExpr("head AS fact").limit(1)
    assert ancestors(r, goal, prime=True).count() == 2
    bad = Engine(spark)
    bad.load("p(a). q(X) :- p(X), not r(X). r(X) :- p(X), not q(X).")
    with pytest.raises(PlanError):
        bad.chase()


def test_heads_without_facts_are_empty(spark):
    e = Engine(spark)
    e.load("n(1), n(2). m(1, 2). rich(X) :- n(X). poor(X) :- n(X), not rich(X). poorer(X, Z, Y) :- poor(X), m(X, Y). flag() :- poor(X). odd(X) :- odd(X).")
    layers = [[e.rules[0]], [e.rules[1]], e.rules[2:]]
    r = chase(e.catalog, e.rules, layers=layers)
    assert [r.frame(n, k).count() for n, k in (("rich", 1), ("poor", 1), ("poorer", 3), ("flag", 0), ("odd", 1))] == [2, 0, 0, 0, 0]
    kind = r.frame("rich", 1).schema["c0"].dataType
    assert r.frame("poor", 1).schema["c0"].dataType == kind and [r.frame("poorer", 3).schema[i].dataType for i in (0, 2)] == [kind, kind]
    assert r.frame("poorer", 3).dtypes[1][1].startswith("struct") and r.frame("odd", 1).dtypes == [("c0", "string")]
    assert e.chase(max_steps=0).frame("rich", 1).collect() == [] and e.chase(keep=frozenset(["poor"])).frame("poor", 1).collect() == []
    for absent in (r, e.chase(keep=frozenset(["rich"]))):
        with pytest.raises(KeyError):
            absent.frame("poor", 2 if absent is r else 1)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_strata_from_outside(spark, size):
    """At sf0.01 every nation has a rich customer: no rows, and the column's type as where there are some."""
    import duckdb

    from lodestone.queries import QUERIES, SQL

    db = duckdb.connect()
    for t in ("customer", "nation"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{size}/{t}.parquet'")
    got = QUERIES["chase_external_strata"](spark, f"/root/testdata/{size}")
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(SQL["chase_external_strata"]).fetchall())
    assert got.dtypes == [("n", dict(spark.read.parquet(f"/root/testdata/{size}/nation.parquet").dtypes)["n_nationkey"])]


def test_rewriting_agrees_with_the_chase(spark):
    e = Engine(spark)
    e.load("emp(a), emp(b), boss(b), works(c,d). works(X,Y) :- emp(X). emp(X) :- boss(X). busy(X) :- works(X,Y).")
    for q in ("?(X) :- busy(X).", "?(X) :- works(X,Y), busy(X).", "?() :- works(X,Y), emp(X)."):
        assert answers(e.ask_rewritten(q)) == answers(e.saturated().ask(q))
    e.load("! :- boss(X), emp(X).")
    assert len(e.saturated().violations()) == 1 and e.properties()["linear"]


def test_files(spark, tmp_path):
    e = Engine(spark)
    (tmp_path / "People.csv").write_text("name;age\nann;3\nbob;\"4;5\"\n")
    assert files.add_csv(e.catalog, str(tmp_path / "People.csv"), options=files.CsvOptions(";", "x_", 1)) == "x_people"
    assert answers(e.ask("?(X,Y) :- x_people(X,Y).")) == [("ann", "3"), ("bob", "4;5")]
    (tmp_path / "bad.csv").write_text("a,b\nc\n")
    with pytest.raises(Exception, match="ragged"):
        files.read_csv(spark, str(tmp_path / "bad.csv")).collect()
    ttl = "@prefix x: <http://x/>. x:a a x:T ; x:p x:b, \"l\"@en, 3 . [] x:p (1 2) ."
    (tmp_path / "g.ttl").write_text(ttl)
    triples = files.read_rdf(spark, str(tmp_path / "g.ttl"))
    assert triples.count() == 9
    files.add_rdf(e.catalog, triples.where("s.k = 'c'"))
    assert answers(e.ask("?(X) :- <http://x/T>(X).")) == [("http://x/a",)]
    store = Engine(spark)
    files.triple_store(store.catalog, triples)
    assert answers(store.ask("?(Y) :- <http://x/p>(<http://x/a>, Y).")) == [("3",), ("http://x/b",), ("l",)]
    files.write_ntriples(triples, str(tmp_path / "out"))
    assert files.read_ntriples(spark, str(tmp_path / "out")).count() == 9
    files.write_facts(e.catalog.sources["x_people", 2].frame(), "p", str(tmp_path / "facts"))
    back = Engine(spark)
    back.load("\n".join(r.value for r in spark.read.text(str(tmp_path / "facts")).collect()))
    assert back.catalog.count() == 2
    assert files.detect_format("x", "<http://a> <http://b> <http://c> .") == "rdf" and files.detect_format("x", "p(a).") == "dlgpe" and files.detect_format("a.csv") == "csv"
    with pytest.raises(KeyError):
        files.parser("none")


def test_imports_views_and_computed(spark, tmp_path):
    with sqlite3.connect(tmp_path / "people.db") as db:
        db.execute("CREATE TABLE people (name TEXT, boss TEXT)")
        db.executemany("INSERT INTO people VALUES (?, ?)", [("ann", "bob"), ("bob", None), ("cy", "ann")])
    sources = [{"id": "db", "protocol": "SQLite", "parameters": {"url": "people.db"}}, {"id": "web", "protocol": "JSONWebAPI", "parameters": {}}, {"id": "rdf", "protocol": "SPARQLEndpoint", "parameters": {}}, {"id": "docs", "protocol": "MongoDB", "parameters": {"file": "docs.jsonl"}}]
    declared = [
        {"id": "people", "datasource": "db", "query": "SELECT name, boss FROM people", "signature": [{}, {"ifMissing": "IGNORE"}]},
        {"id": "holes", "datasource": "db", "query": "SELECT name, boss FROM people", "signature": [{}, {"ifMissing": "EXIST"}]},
        {"id": "bossof", "datasource": "db", "query": "SELECT name, boss FROM people WHERE name = %%who%%", "signature": [{"mandatory": "who"}, {"ifMissing": "IGNORE"}]},
        {"id": "ages", "datasource": "web", "query": "ages.json", "position": "$.rows[*]", "signature": [{"selection": "$.n"}, {"selection": "$.a"}]},
        {"id": "sp", "datasource": "rdf", "query": "sparql.json", "signature": [{}]},
        {"id": "mo", "datasource": "docs", "query": '[{"$match": {"k": 1}}]', "signature": [{"selection": "x.y"}]},
    ]
    (tmp_path / "ages.json").write_text(json.dumps({"rows": [{"n": "ann", "a": 3}, {"n": "bob", "a": 4}]}))
    (tmp_path / "sparql.json").write_text(json.dumps({"head": {"vars": ["s"]}, "results": {"bindings": [{"s": {"type": "uri", "value": "http://x"}}]}}))
    (tmp_path / "docs.jsonl").write_text('{"k": 1, "x": {"y": "deep"}}\n{"k": 2, "x": {"y": "no"}}\n')
    (tmp_path / "v.vd").write_text(json.dumps({"datasources": sources, "views": declared}))
    (tmp_path / "tools.py").write_text("def shout(x: str) -> str:\n    return x.upper()\n\ndef _hidden(x):\n    return x\n")
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": 1, "default": {"providers": {"python": {"module": "tools", "path": "tools.py"}}}}))
    (tmp_path / "base.dlgpe").write_text("known(ann).")
    (tmp_path / "main.dlgpe").write_text("@import <base.dlgpe>.\n@computed my: <c.json>.\n@view v:<v.vd>.\n?(X,Y) :- known(X), v:bossof(X,Y).\n?(X,Y) :- v:people(X,Y).\n?(Y) :- known(X), my:shout(X,Y).")
    e = Engine(spark)
    doc = e.load_file(str(tmp_path / "main.dlgpe"))
    assert [answers(e.ask(q)) for q in doc.queries] == [[("ann", "bob")], [("ann", "bob"), ("cy", "ann")], [("ANN",)]]
    assert answers(e.ask("?(X,A) :- v:ages(X,A).")) == [("ann", "3"), ("bob", "4")]
    assert answers(e.ask("?(X) :- v:sp(X).")) == [("http://x",)] and answers(e.ask("?(X) :- v:mo(X).")) == [("deep",)]
    assert sorted(r.Y.k for r in e.ask("?(X,Y) :- v:holes(X,Y).").collect()) == ["c", "c", "n"]
    with pytest.raises(PlanError):
        e.ask("?(X,Y) :- v:bossof(X,Y).")
    with pytest.raises(PlanError, match="twice"):
        views.read_document(json.dumps({"datasources": sources, "views": declared * 2}))
    with pytest.raises(PlanError, match="query or queryFile"):
        views.read_document(json.dumps({"datasources": sources, "views": [{"id": "a", "datasource": "db", "signature": []}]}))
    assert views.jdbc_options("PostgreSQL", {"url": "h/db", "user": "u"})["url"] == "jdbc:postgresql://h/db"


def test_cli(tmp_path, capsys):
    (tmp_path / "q.dlgp").write_text("g(X,X) :- v(X).\n?(X,Y) :- g(X,Y).")
    assert cli.main([str(tmp_path / "q.dlgp"), "-v"]) == 0 and "v(X)" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "q.dlgp"), "-m"]) == 0


def test_names_with_anon(e, spark):
    """A variable's name does not decide whether a NULL hides its row."""
    e.catalog.add("t", spark.createDataFrame([(1, None), (2, "x")], "a int, b string"))
    for query in ("?(A) :- t(A, B).", "?(A) :- t(A, Canon).", "?(A) :- t(A, Anon_1), not gone(A)."):
        assert answers(e.ask(query)) == [("2",)], query
    assert answers(e.ask("?(A) :- t(A, _).")) == [("1",), ("2",)]


def test_headers_go_by_place(spark, tmp_path):
    """Data rows that equal the header stay; every file has its own header."""
    folder = tmp_path / "x.csv"
    folder.mkdir()
    (folder / "one.csv").write_text("a,b\n1,2\na,b\n3,4\n")
    (folder / "two.csv").write_text("c,d\n5,6\n1,2\n")
    got = files.read_csv(spark, str(folder), files.CsvOptions(header_rows=1))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "2"), ("1", "2"), ("3", "4"), ("5", "6"), ("a", "b")]
    got = files.read_csv(spark, str(folder / "one.csv"), files.CsvOptions(header_rows=3))
    assert [tuple(r) for r in got.collect()] == [("3", "4")]
    (tmp_path / "lines.csv").write_text('h,"i\nj"\n1,"two\nlines"\n"say ""x""",3\n')
    got = files.read_csv(spark, str(tmp_path / "lines.csv"), files.CsvOptions(header_rows=1, multi_line=True))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "two\nlines"), ('say "x"', "3")]
