import json

import pytest

from lodestone.plans.encoding import PlanError
from lodestone.sources import files
from lodestone.sources.rdf_documents import parse_jsonld, parse_rdfxml
from lodestone.terms import RDF, XSD

X = "http://x/"
HEAD = f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:x="{X}" xml:base="http://x/doc">'


def shown(triples):
    return {tuple(t[1] + (f"^{t[2]}" if t[0] == "l" else "") + (f"@{t[3]}" if t[3] else "") for t in triple) for triple in triples}


def test_rdfxml_nodes_and_literals():
    text = f"""{HEAD}
      <x:T rdf:about="http://x/a" x:nick="al"><x:p rdf:resource="b"/><x:q rdf:datatype="{XSD}integer">3</x:q><x:r xml:lang="en">hi</x:r></x:T>
      <rdf:Description rdf:ID="c"><x:p><rdf:Description rdf:about="http://x/d"><x:p>deep</x:p></rdf:Description></x:p></rdf:Description>
    </rdf:RDF>"""
    assert shown(parse_rdfxml(text)) == {
        (X + "a", RDF + "type", X + "T"),
        (X + "a", X + "nick", "al"),
        (X + "a", X + "p", X + "b"),
        (X + "a", X + "q", "3^integer"),
        (X + "a", X + "r", "hi^langString@en"),
        (X + "doc#c", X + "p", X + "d"),
        (X + "d", X + "p", "deep"),
    }


def test_rdfxml_blanks_containers_and_collections():
    text = f"""{HEAD}
      <rdf:Bag rdf:nodeID="n"><rdf:li>u</rdf:li><rdf:li rdf:nodeID="n"/></rdf:Bag>
      <rdf:Description rdf:about="http://x/a">
        <x:list rdf:parseType="Collection"><x:T rdf:about="http://x/b"/></x:list>
        <x:inner rdf:parseType="Resource"><x:p>v</x:p></x:inner>
        <x:said rdf:ID="s">w</x:said>
      </rdf:Description>
    </rdf:RDF>"""
    found = parse_rdfxml(text)
    bag = next(s for s, p, o in found if o[1] == RDF + "Bag")
    assert bag[0] == "n" and (bag, ("c", RDF + "_1", "", ""), ("c", "u", "", "")) in found and (bag, ("c", RDF + "_2", "", ""), bag) in found
    head = next(o for s, p, o in found if p[1] == X + "list")
    assert (head, ("c", RDF + "first", "", ""), ("c", X + "b", "", "")) in found and (head, ("c", RDF + "rest", "", ""), ("c", RDF + "nil", "", "")) in found
    inner = next(o for s, p, o in found if p[1] == X + "inner")
    assert inner[0] == "n" and any(s == inner and o[1] == "v" for s, _, o in found)
    assert (X + "doc#s", RDF + "object", "w") in shown(found)
    assert parse_rdfxml(f"{HEAD}</rdf:RDF>") == []
    with pytest.raises(PlanError):
        parse_rdfxml("no xml")


def test_jsonld_context_and_values():
    document = {
        "@context": {"x": X, "name": "x:name", "knows": {"@id": "x:knows", "@type": "@id"}, "age": {"@id": "x:age", "@type": XSD + "integer"}, "of": {"@reverse": "x:has"}, "row": {"@id": "x:row", "@container": "@list"}},
        "@id": "x:a",
        "@type": "x:T",
        "name": ["al", {"@value": "hi", "@language": "en"}],
        "knows": ["http://x/b", {"@id": "x:c", "name": None, "x:flag": True}],
        "age": "3",
        "of": {"@id": "x:d"},
        "row": ["u"],
        "unknown": "dropped",
    }
    found = parse_jsonld(json.dumps(document))
    head = next(o for s, p, o in found if p[1] == X + "row")
    rest = [t for t in found if t[0] != head and t[2] != head]
    assert shown(rest) == {
        (X + "a", RDF + "type", X + "T"),
        (X + "a", X + "name", "al"),
        (X + "a", X + "name", "hi^langString@en"),
        (X + "a", X + "knows", X + "b"),
        (X + "a", X + "knows", X + "c"),
        (X + "c", X + "flag", "true^boolean"),
        (X + "a", X + "age", "3^integer"),
        (X + "d", X + "has", X + "a"),
    }
    assert (head, ("c", RDF + "first", "", ""), ("c", "u", "", "")) in found
    assert shown(parse_jsonld('{"@context": {"@vocab": "http://v/"}, "@graph": [{"@id": "http://x/a", "p": 1.5}]}')) == {(X + "a", "http://v/p", "1.5^double")}
    assert parse_jsonld("[]") == []
    for bad in ("{", "[1]", '{"@context": "http://elsewhere"}'):
        with pytest.raises(PlanError):
            parse_jsonld(bad)


def test_trig_and_files_of_all_formats(spark, tmp_path):
    body = {
        "g.trig": "@prefix x: <http://x/>. x:a x:p x:b . x:g { x:b x:p x:c . x:c x:p x:d } GRAPH x:h { [ x:p x:e ] . } { x:e x:p 1 . }",
        "g.rdf": f'{HEAD}<rdf:Description rdf:about="http://x/a"><x:p rdf:resource="http://x/b"/></rdf:Description></rdf:RDF>',
        "g.jsonld": '{"@id": "http://x/a", "http://x/p": {"@id": "http://x/b"}}',
    }
    for name, text in body.items():
        (tmp_path / name).write_text(text)
        triples = files.read_rdf(spark, str(tmp_path / name))
        assert triples.where("s.v = 'http://x/a' AND p.v = 'http://x/p' AND o.v = 'http://x/b'").count() == 1
        assert triples.count() == (5 if name == "g.trig" else 1)
    with pytest.raises(PlanError):
        files.parse_turtle("@prefix x: <http://x/>. x:g { x:a x:p x:b")
