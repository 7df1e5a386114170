"""RDF documents read on the driver: RDF/XML and JSON-LD, as triples of TERM tuples.

These formats nest, so a file is read whole; N-Triples and N-Quads are the ones for large data.
Names of graphs are not kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

from lodestone.plans.encoding import PlanError
from lodestone.terms import RDF, XSD

Term = tuple[str, str, str, str]
Triple = tuple[Term, Term, Term]

_XML = "{http://www.w3.org/XML/1998/namespace}"


def iri(value: str) -> Term:
    return "c", value, "", ""


def literal(text: str, datatype: str = "", lang: str = "") -> Term:
    """A literal by its datatype's IRI; plain strings are constants."""
    if lang:
        return "l", text, "langString", lang
    local = re.sub(f"^({re.escape(XSD)}|{re.escape(RDF)})", "", datatype)
    return ("c", text, "", "") if local in ("", "string") else ("l", text, local, "")


class _Blanks:
    """Labelled nulls: one per name of the document, and fresh ones."""

    def __init__(self):
        self.n = 0

    def fresh(self) -> Term:
        self.n += 1
        return "n", f"_:b{self.n}", "", ""

    @staticmethod
    def named(name: str) -> Term:
        # names of the document cannot meet fresh ones
        return "n", f"_:n-{name}", "", ""


def chain(items: list[Term], blanks: _Blanks, out: list[Triple]) -> Term:
    """A collection as first/rest triples; its head."""
    head = iri(RDF + "nil")
    for item in reversed(items):
        node = blanks.fresh()
        out += [(node, iri(RDF + "first"), item), (node, iri(RDF + "rest"), head)]
        head = node
    return head


# RDF/XML
def parse_rdfxml(text: str, base: str = "") -> list[Triple]:
    """Node and property elements, typed nodes, property attributes, containers, collections, literals."""
    blanks, out = _Blanks(), []
    r = "{" + RDF + "}"

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def attributes(element) -> Iterator[tuple[str, str]]:
        """Property attributes."""
        syntax = {r + x for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType")}
        return ((k, v) for k, v in element.attrib.items() if k not in syntax and not k.startswith(_XML))

    def described(subject: Term, element, lang: str) -> None:
        for k, v in attributes(element):
            out.append((subject, iri(name(k)), iri(urljoin(base_of(element), v)) if k == r + "type" else literal(v, lang=lang)))

    bases: dict = {}

    def base_of(element) -> str:
        return bases[element]

    def node(element, lang: str, here: str) -> Term:
        lang, here = element.get(_XML + "lang", lang), element.get(_XML + "base", here)
        bases[element] = here
        if (about := element.get(r + "about")) is not None:
            subject = iri(urljoin(here, about))
        elif (own := element.get(r + "ID")) is not None:
            subject = iri(urljoin(here, "#" + own))
        elif (label := element.get(r + "nodeID")) is not None:
            subject = blanks.named(label)
        else:
            subject = blanks.fresh()
        if element.tag != r + "Description":
            out.append((subject, iri(RDF + "type"), iri(name(element.tag))))
        described(subject, element, lang)
        properties(subject, element, lang, here)
        return subject

    def properties(subject: Term, element, lang: str, here: str) -> None:
        items = 0
        for child in element:
            tag = name(child.tag)
            if child.tag == r + "li":
                items += 1
                tag = f"{RDF}_{items}"
            value = content(child, child.get(_XML + "lang", lang), child.get(_XML + "base", here))
            out.append((subject, iri(tag), value))
            if own := child.get(r + "ID"):
                statement = iri(urljoin(child.get(_XML + "base", here), "#" + own))
                parts = (("type", iri(RDF + "Statement")), ("subject", subject), ("predicate", iri(tag)), ("object", value))
                out.extend((statement, iri(RDF + p), o) for p, o in parts)

    def content(child, lang: str, here: str) -> Term:
        bases[child] = here
        kind = child.get(r + "parseType")
        if kind == "Resource":
            value = blanks.fresh()
            properties(value, child, lang, here)
            return value
        if kind == "Collection":
            return chain([node(x, lang, here) for x in child], blanks, out)
        if kind is not None:
            inner = (child.text or "") + "".join(ElementTree.tostring(x, encoding="unicode") for x in child)
            return literal(inner, RDF + "XMLLiteral")
        if len(child):
            if len(child) > 1:
                raise PlanError(f"{name(child.tag)} holds more than one node")
            return node(child[0], lang, here)
        if (target := child.get(r + "resource")) is not None:
            value = iri(urljoin(here, target))
        elif (label := child.get(r + "nodeID")) is not None:
            value = blanks.named(label)
        elif any(True for _ in attributes(child)):
            value = blanks.fresh()
        else:
            return literal(child.text or "", child.get(r + "datatype", ""), "" if child.get(r + "datatype") else lang)
        described(value, child, lang)
        return value

    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as error:
        raise PlanError(f"no RDF/XML: {error}") from error
    if root.tag == r + "RDF":
        for element in root:
            node(element, root.get(_XML + "lang", ""), root.get(_XML + "base", base))
    else:
        node(root, "", base)
    return out


# JSON-LD
_KEYWORDS = ("@id", "@type", "@graph", "@value", "@language", "@list", "@set", "@context", "@reverse", "@index")


class _Context:
    """Terms, prefixes, vocabulary, base and language of a context kept in the document."""

    def __init__(self, base: str = ""):
        self.base, self.vocab, self.lang = base, "", ""
        self.terms: dict[str, dict] = {}

    def extended(self, given) -> _Context:
        out = _Context(self.base)
        out.vocab, out.lang, out.terms = self.vocab, self.lang, dict(self.terms)
        for part in given if isinstance(given, list) else [given]:
            if part is None:
                out = _Context(self.base)
                continue
            if not isinstance(part, dict):
                raise PlanError(f"the context {part} is not in the document")
            out.base = urljoin(out.base, part["@base"] or "") if "@base" in part else out.base
            out.vocab, out.lang = part.get("@vocab", out.vocab) or "", part.get("@language", out.lang) or ""
            for term, value in part.items():
                if not term.startswith("@"):
                    out.terms[term] = value if isinstance(value, dict) else {"@id": value}
        return out

    def expand(self, value: str, seen: frozenset = frozenset()) -> str:
        """A property or class as keyword or IRI; empty if the context does not know it."""
        if value in _KEYWORDS:
            return value
        if value in self.terms and value not in seen:
            target = self.terms[value].get("@id", value)
            return self.expand(target, seen | {value}) if target else ""
        prefix, colon, local = value.partition(":")
        if colon:
            known = prefix in self.terms and prefix not in seen and not local.startswith("//")
            return self.expand(prefix, seen | {value}) + local if known else value
        return self.vocab + value if self.vocab else ""

    def resource(self, value: str) -> Term:
        if value.startswith("_:"):
            return _Blanks.named(value[2:])
        prefix, colon, _ = value.partition(":")
        return iri(self.expand(value) if colon and prefix in self.terms else urljoin(self.base, value))


def parse_jsonld(text: str, base: str = "") -> list[Triple]:
    """Objects with contexts of their own, types, values, languages, lists, sets, reverse properties and graphs."""
    blanks, out = _Blanks(), []

    def every(value) -> list:
        return value if isinstance(value, list) else [value]

    def scalar(value, rule: dict, c: _Context) -> Term:
        kind = rule.get("@type")
        if isinstance(value, str) and kind in ("@id", "@vocab"):
            return c.resource(value) if kind == "@id" or not c.expand(value) else iri(c.expand(value))
        datatype = c.expand(kind) if kind else ""
        if isinstance(value, bool):
            return literal(str(value).lower(), datatype or XSD + "boolean")
        if isinstance(value, int):
            return literal(str(value), datatype or XSD + "integer")
        if isinstance(value, float):
            return literal(repr(value), datatype or XSD + "double")
        return literal(value, datatype, "" if datatype else rule.get("@language", c.lang) or "")

    def term(value, rule: dict, c: _Context) -> Term:
        if not isinstance(value, dict):
            return scalar(value, rule, c)
        keys = {c.expand(k): v for k, v in value.items()}
        if "@value" in keys:
            own = {"@type": keys["@type"]} if keys.get("@type") else {"@language": keys.get("@language", "")}
            return scalar(keys["@value"], own, c)
        if "@list" in keys:
            return chain([term(x, rule, c) for x in every(keys["@list"]) if x is not None], blanks, out)
        return node(value, c)

    def values(value, rule: dict, c: _Context) -> Iterator[Term]:
        if rule.get("@container") == "@list" and not isinstance(value, dict):
            yield term({"@list": value}, rule, c)
        elif rule.get("@container") == "@language" and isinstance(value, dict):
            yield from (literal(x, lang=lang) for lang, texts in value.items() for x in every(texts))
        else:
            for x in every(value):
                if isinstance(x, dict) and "@set" in x:
                    yield from values(x["@set"], rule, c)
                elif x is not None:
                    yield term(x, rule, c)

    def node(value: dict, c: _Context) -> Term:
        if "@context" in value:
            c = c.extended(value["@context"])
        named = next((v for k, v in value.items() if c.expand(k) == "@id"), None)
        subject = c.resource(named) if named is not None else blanks.fresh()
        for key, given in value.items():
            full, rule = c.expand(key), c.terms.get(key, {})
            if full == "@type":
                out.extend((subject, iri(RDF + "type"), iri(c.expand(x)) if c.expand(x) else c.resource(x)) for x in every(given))
            elif full == "@graph":
                for x in every(given):
                    node(x, c)
            elif full == "@reverse":
                for k, v in given.items():
                    out.extend((o, iri(c.expand(k)), subject) for o in values(v, {"@type": "@id"}, c))
            elif "@reverse" in rule:
                out.extend((o, iri(c.expand(rule["@reverse"])), subject) for o in values(given, {"@type": "@id"}, c))
            elif full and not full.startswith("@"):
                out.extend((subject, iri(full), o) for o in values(given, rule, c))
        return subject

    try:
        document = json.loads(text)
    except json.JSONDecodeError as error:
        raise PlanError(f"no JSON-LD: {error}") from error
    for part in every(document):
        if not isinstance(part, dict):
            raise PlanError("a JSON-LD document holds objects")
        node(part, _Context(base))
    return out
