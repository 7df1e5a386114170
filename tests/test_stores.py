import sqlite3

import pytest

from lodestone.engine import Engine
from lodestone.plans.encoding import PlanError
from lodestone.sources import views
from lodestone.sources.stores import AdHocLayout, EncodedLayout, NaturalLayout, SparkStore, StorageBuilder, insert_statement
from lodestone.syntax import Atom, Query
from lodestone.terms import Const, Lit, Var


def answers(df):
    return sorted(tuple(r) for r in df.collect())


def test_layouts():
    encoded, adhoc = EncodedLayout(), AdHocLayout()
    names = ["p", "P", "a b", "a_b", "\u00e9", ""]
    assert len({encoded.table((n, 2)) for n in names}) == len(names) and all(encoded.key(encoded.table((n, 2))) == (n, 2) for n in names)
    assert adhoc.table(("a b", 2)) == "p_a_b_2" and adhoc.key("p_a_b_2") == ("a b", 2) and encoded.key("other") is None
    with pytest.raises(PlanError):
        adhoc.table(("a_b", 2))
    assert NaturalLayout({"p": "people"}).table(("p", 2)) == "people" and NaturalLayout().table(("q", 1)) == "q"


def test_statements():
    assert insert_statement("sqlite", "t", ["a"]) == 'INSERT OR IGNORE INTO "t" ("a") VALUES (?)'
    assert insert_statement("postgresql", "t", ["a", "b"]).endswith("ON CONFLICT DO NOTHING") and insert_statement("mysql", "t", ["a"], "`").startswith("INSERT IGNORE")


@pytest.mark.parametrize("layout", ["adhoc", "encoded", "natural"])
def test_sqlite(spark, tmp_path, layout):
    path = tmp_path / "facts.db"
    make = lambda: StorageBuilder().use_sqlite(path).layout(layout).build(spark)
    e = Engine(spark)
    e.catalog.store = make()
    rows = spark.createDataFrame([(i, f"n{i}", i / 2, i % 2 == 0) for i in range(100)], "a int, b string, c double, d boolean")
    for part in (rows.where("a < 60"), rows.where("a > 40"), rows):
        e.catalog.insert(("known", 4), part)
    again = Engine(spark)
    again.catalog.store = make()
    assert answers(again.ask("?(A,B,C,D) :- known(A,B,C,D).")) == answers(rows)
    assert answers(again.ask('?(A) :- known(A,"n7",C,D).')) == [(7,)]
    # rules read stored facts
    again.load("even(A) :- known(A,B,C,true).")
    assert again.saturated().ask("?(A) :- even(A).").count() == 50
    assert again.ask("?(A) :- unknown(A).").count() == 0
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT count(*) FROM sqlite_master WHERE type = 'table'").fetchone() == (1,)
    with pytest.raises(PlanError):
        e.catalog.store.add(("mixed", 1), spark.sql("SELECT named_struct('k', 'n', 'v', 'x', 'dt', '', 'lang', '') AS t"))
    with pytest.raises(PlanError):
        e.catalog.store.add(("known", 3), rows)


def test_sqlite_pushes_equalities(spark, tmp_path):
    path = tmp_path / "x.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE people (id INTEGER, name TEXT)")
        db.executemany("INSERT INTO people VALUES (?, ?)", [(i, f"n{i % 3}") for i in range(30)] + [(99, None)])
    store = StorageBuilder().use_sqlite(path).layout(NaturalLayout({"person": "people"})).build(spark)
    df = store.source(("person", 2)).frame()
    assert df.count() == 31 and df.where("c1 = 'n1'").count() == 10 and df.where("c0 = 99").first().c1 is None
    assert store.source(("person", 3)) is None and store.source(("nobody", 2)) is None


def test_spark_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS lodestone_test")
    try:
        store = StorageBuilder().use_spark("lodestone_test").build(spark)
        assert isinstance(store, SparkStore)
        e = Engine(spark)
        e.catalog.store = store
        e.catalog.insert(("p q", 2), spark.createDataFrame([(1, "a"), (2, "b")], "a int, b string"))
        e.catalog.insert(("p q", 2), spark.createDataFrame([(2, "b"), (3, "c")], "a int, b string"))
        back = Engine(spark)
        back.catalog.store = store
        assert answers(back.ask(Query((Var("X"), Var("Y")), Atom("p q", (Var("X"), Var("Y")))), ["x", "y"])) == [(1, "a"), (2, "b"), (3, "c")]
        assert back.ask(Query((Var("X"),), Atom("p q", (Var("X"), Const("c"))))).first()[0] == 3
    finally:
        spark.sql("DROP DATABASE IF EXISTS lodestone_test CASCADE")


def test_memory_and_triples(spark):
    for store in (StorageBuilder().use_memory().build(spark), StorageBuilder().use_triples().build(spark)):
        for _ in range(2):
            store.add(("knows", 2), spark.createDataFrame([("a", "b"), ("b", "c")], "x string, y string"))
            store.add(("node", 1), spark.createDataFrame([("a",)], "x string"))
        assert store.source(("knows", 2)).frame().count() == 2 and store.source(("node", 1)).frame().count() == 1
    with pytest.raises(PlanError):
        store.add(("wide", 3), spark.createDataFrame([("a", "b", "c")], "x string, y string, z string"))
    with pytest.raises(PlanError):
        StorageBuilder().use_triples().layout("adhoc").build(spark)
    with pytest.raises(PlanError):
        StorageBuilder().layout("none")


def test_json_views_are_read_by_executors(spark, tmp_path):
    (tmp_path / "all.json").write_text('{"items": [{"id": 1, "to": "http://x/a", "n": 2.5, "ok": true}, {"id": 2, "to": "_:b", "n": null, "ok": false}]}')
    signature = [{"selection": "$.id", "type": "bigint"}, {"selection": "$.to", "type": "term"}, {"selection": "$.n", "type": "double", "ifMissing": "IGNORE"}]
    doc = {"datasources": [{"id": "api", "protocol": "JSONWebAPI", "parameters": {"url": str(tmp_path) + "/"}}], "views": [{"id": "item", "datasource": "api", "query": "all.json", "position": "$.items[*]", "signature": signature}]}
    import json

    e = Engine(spark)
    views.add_views(e.catalog, views.read_document(json.dumps(doc)))
    assert answers(e.ask("?(I) :- item(I, T, N), N > 2.0.")) == [(1,)]
    signature[2]["ifMissing"] = "DEFAULT"
    signature[2]["type"] = "term"
    f = Engine(spark)
    views.add_views(f.catalog, views.read_document(json.dumps(doc)))
    got = f.catalog.find(("item", 3)).frame()
    assert sorted((r.c0, r.c1.k, r.c2 and (r.c2.v, r.c2.dt)) for r in got.collect()) == [(1, "c", ("2.5", "double")), (2, "n", None)]
    signature[0]["type"] = "set"
    with pytest.raises(PlanError):
        views.read_document(json.dumps(doc))


def test_counts_estimates_and_cleanup(spark):
    e = Engine(spark)
    e.load("p(a), p(b). q(b), q(c), q(d). r(X) :- p(X).")
    assert e.count("?(X) :- p(X), q(X).") == 1
    assert [e.estimate(f"?(X) :- {b}.") for b in ("p(X), q(Y)", "p(X) | q(X)", "p(X), none(X)", "p(X), not q(X)", "p(X), X != a")] == [6, 5, 0, 2, 2]
    assert e.saturated().ask("?(X) :- r(X).").count() == 2
    stats = e.close()
    assert (stats.sources, stats.rules) == (2, 1) and stats.tables > 0 and not e.catalog.sources and e.close().tables == 0
    assert Lit
