import pytest

from lodestone.operators.chase import chase
from lodestone.parser import parse
from lodestone.plans.encoding import PlanError
from lodestone.sources.catalog import Catalog
from lodestone.streaming import Saturation


def pairs(catalog):
    return sorted(tuple(r) for r in catalog.find(("t", 2)).frame().collect())


def test_batches_add_up(spark, tmp_path):
    doc = parse("e(a,b). t(X,Y) :- e(X,Y). t(X,Z) :- t(X,Y), t(Y,Z).")
    s = Saturation(Catalog(spark).add_facts(doc.facts), doc.rules)
    spark.createDataFrame([("b", "c"), ("c", "d")], "x string, y string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x string, y string").parquet(str(tmp_path / "in"))
    s.attach("e", stream, str(tmp_path / "at"), once=True).awaitTermination()
    whole = Catalog(spark).add_facts([*doc.facts, *parse("e(b,c), e(c,d).").facts])
    assert pairs(s.catalog) == pairs(chase(whole, doc.rules).catalog) and len(pairs(s.catalog)) == 6
    assert s.add("e", spark.createDataFrame([("b", "c")], "x string, y string")) == 0
    with pytest.raises(PlanError):
        chase(whole, parse("u(X) :- e(X,Y), not e(Y,X).").rules, changed={})


def test_failed_batch_is_repeated(spark, tmp_path, monkeypatch):
    """The first chase of a batch fails; the repetition still has all consequences."""
    from lodestone.streaming import incremental

    doc = parse("e(a,b). t(X,Y) :- e(X,Y). t(X,Z) :- t(X,Y), t(Y,Z).")
    s = Saturation(Catalog(spark).add_facts(doc.facts), doc.rules)
    whole, calls = incremental.chase, []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return whole(*args, **kwargs)

    monkeypatch.setattr(incremental, "chase", failing)
    rows = spark.createDataFrame([("b", "c")], "x string, y string")
    with pytest.raises(RuntimeError):
        s.add("e", rows)
    assert pairs(s.catalog) == [("a", "b")]
    assert s.add("e", rows) == 1 and pairs(s.catalog) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_restarted_driver(spark, tmp_path):
    """A new driver that attaches to the checkpoint has the rows of earlier batches."""
    doc = parse("e(a,b). t(X,Y) :- e(X,Y). t(X,Z) :- t(X,Y), t(Y,Z).")
    at, folder = str(tmp_path / "at"), str(tmp_path / "in")

    def run(rows):
        spark.createDataFrame(rows, "x string, y string").write.mode("append").parquet(folder)
        s = Saturation(Catalog(spark).add_facts(doc.facts), doc.rules)
        s.attach("e", spark.readStream.schema("x string, y string").parquet(folder), at, once=True).awaitTermination()
        return pairs(s.catalog)

    assert len(run([("b", "c")])) == 3
    assert len(run([("c", "d")])) == 6
