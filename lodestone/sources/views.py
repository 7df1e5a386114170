"""Declared views: a JSON document of data sources and of relations over them.

A view is a predicate.  Positions marked mandatory need bindings; a query reads them
through a placeholder %%name%%, which becomes a bound parameter or a lateral reference, never
pasted text.  Missing values (NULL or "") follow the position's policy: IGNORE drops the row, FREEZE
(default for strings; typed positions just lose the row) makes a constant, EXIST a null keyed by the row, OPTIONAL a fresh null.
"""

from __future__ import annotations

import json
import re
import sqlite3
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.encoding import PlanError, term_struct, to_term
from lodestone.sources.catalog import Catalog, Source, positional

#: Types that a position can be declared with.
KINDS = ("string", "term", "bigint", "int", "double", "boolean", "date", "timestamp")
POLICIES = ("IGNORE", "FREEZE", "EXIST", "OPTIONAL")


@dataclass(frozen=True)
class Position:
    mandatory: str | None = None
    missing: str = "DEFAULT"
    selection: str | None = None
    #: Type of the position: a Spark type, or "term" for text whose form tells its kind.
    type: str = "string"


@dataclass(frozen=True)
class View:
    id: str
    datasource: str
    signature: tuple[Position, ...]
    query: str | None = None
    position: str | None = None


@dataclass(frozen=True)
class Document:
    datasources: dict[str, dict]
    views: tuple[View, ...]
    warnings: tuple[str, ...] = field(default=())


def read_document(text: str, base: str = ".") -> Document:
    """Parse and validate a view document; query files are relative to it."""
    raw = json.loads(text)
    problems, notes = [], []
    sources = raw.get("datasources", [])
    ids = [s.get("id") for s in sources]
    problems += [f"datasource {i} is declared twice" for i in {i for i in ids if ids.count(i) > 1}]
    for s in sources:
        given = s.get("parameters", {})
        if "password" in given and "passwordFile" in given:
            problems.append(f"datasource {s.get('id')} has password and passwordFile")
        if s.get("protocol") not in BACKENDS:
            notes.append(f"unknown protocol {s.get('protocol')}")
    names = [v.get("id") for v in raw.get("views", [])]
    problems += [f"view {i} is declared twice" for i in {i for i in names if names.count(i) > 1}]
    views = []
    for v in raw.get("views", []):
        if v.get("datasource") not in ids:
            problems.append(f"view {v.get('id')} has no datasource {v.get('datasource')}")
        if ("query" in v) == ("queryFile" in v):
            problems.append(f"view {v.get('id')} needs query or queryFile")
        query = v.get("query")
        if query is None and "queryFile" in v:
            query = (Path(base) / v["queryFile"]).read_text(encoding="utf-8")
        signature = []
        for p in v.get("signature", []):
            policy = str(p.get("ifMissing", "DEFAULT")).upper()
            if policy not in (*POLICIES, "DEFAULT"):
                problems.append(f"view {v.get('id')}: no policy {policy}")
            if p.get("type", "string") not in KINDS:
                problems.append(f"view {v.get('id')}: no type {p['type']}")
            signature.append(Position(p.get("mandatory"), policy, p.get("selection"), p.get("type", "string")))
        views.append(View(v.get("id"), v.get("datasource"), tuple(signature), query, v.get("position")))
    if problems:
        raise PlanError("; ".join(problems))
    return Document({s["id"]: s for s in sources}, tuple(views), tuple(notes))


def handle_missing(df: DataFrame, policies: list[str], view: str = "view") -> DataFrame:
    """Apply the policy of each position; columns stay native unless they need nulls."""
    names = df.columns
    for c, policy in zip(names, policies, strict=True):
        t = df.schema[c].dataType
        if policy == "DEFAULT":
            # typed positions stay native: their NULLs hold no term and no atom reads them
            if not isinstance(t, T.StringType):
                continue
            policy = "FREEZE"
        gone = F.col(c).isNull() | (F.col(c) == "" if isinstance(t, T.StringType) else F.lit(False))
        if policy == "IGNORE":
            df = df.where(~gone)
        elif policy == "FREEZE":
            if isinstance(t, T.StringType):
                df = df.withColumn(c, F.when(gone, F.lit(f"{view}_missing")).otherwise(F.col(c)))
            else:
                df = df.withColumn(c, F.when(gone, term_struct("c", F.lit(f"{view}_missing"))).otherwise(to_term(F.col(c), t)))
        else:
            # EXIST: one null for equal rows; OPTIONAL: position and row make it fresh all the same, and repeatable
            tag = "skolem" if policy == "EXIST" else "fresh"
            row = F.sha2(F.to_json(F.struct(*names)), 256)
            df = df.withColumn(c, F.when(gone, term_struct("n", F.concat(F.lit(f"{view}|{c}|{tag}|"), row))).otherwise(to_term(F.col(c), t)))
    return df


# paths into JSON: $, .key, [index], [*]
def json_values(data: object, path: str) -> list:
    if not path.startswith("$"):
        raise PlanError(f"{path} does not start with $")
    now = [data]
    for key, index in re.findall(r"\.([A-Za-z_][\w-]*)|\[(\*|\d+)\]", path[1:]):
        nxt = []
        for x in now:
            if key:
                if isinstance(x, dict) and key in x:
                    nxt.append(x[key])
            elif index == "*":
                nxt += x if isinstance(x, list) else list(x.values()) if isinstance(x, dict) else []
            elif isinstance(x, list) and int(index) < len(x):
                nxt.append(x[int(index)])
        now = nxt
    return now


def json_column(col: Column, path: str) -> Column:
    """The path's text in a JSON column, for paths without [*]."""
    return F.get_json_object(col, path)


def _plain(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value).lower()
    return value if isinstance(value, str) else json.dumps(value) if isinstance(value, (dict, list)) else str(value)


def _placeholder(query: str, put: Callable[[str], str]) -> str:
    return re.sub(r"%%(\w+)%%", lambda m: put(m[1]), query)


def _json_rows(text: str, view: View) -> list[tuple]:
    found = json_values(json.loads(text), view.position or "$")
    rows = []
    for item in found:
        for one in item if isinstance(item, list) and view.position is None else [item]:
            rows.append(tuple(_plain(next(iter(json_values(one, p.selection)), None)) if p.selection else _plain(one) for p in view.signature))
    return rows


def sparql_rows(text: str, view: View) -> list[tuple]:
    """Rows of a SPARQL JSON result, by selection or variable order."""
    data = json.loads(text)
    names = data["head"]["vars"]
    out = []
    for b in data["results"]["bindings"]:
        wanted = [p.selection or names[i] for i, p in enumerate(view.signature)]
        out.append(tuple(("_:" + b[n]["value"] if b[n]["type"] == "bnode" else b[n]["value"]) if n in b else None for n in wanted))
    return out


def mongo_rows(documents: list[dict], view: View) -> list[tuple]:
    """Rows by dotted paths from the documents of an aggregation."""
    def at(doc: object, path: str) -> object:
        for key in path.split("."):
            doc = doc.get(key) if isinstance(doc, dict) else None
        return doc

    return [tuple(_plain(at(d, p.selection or "_id")) for p in view.signature) for d in documents]


def _read(url: str) -> str:
    if re.match(r"https?:", url):
        with urlopen(url, timeout=60) as answer:  # noqa: S310
            return answer.read().decode("utf-8")
    return Path(url.removeprefix("file://")).read_text(encoding="utf-8")


def _sqlite(parameters: dict, base: str) -> Callable[[View, dict], list[tuple]]:
    path = str(Path(base) / parameters["url"])

    def rows(view: View, bound: dict) -> list[tuple]:
        names: list[str] = []
        query = _placeholder(view.query, lambda n: (names.append(n), "?")[1])
        query = query.replace("'?'", "?")
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            return [tuple(None if v is None else _plain(v) for v in r) for r in db.execute(query, [bound[n] for n in names])]

    return rows


def _web(parse: Callable[[str, View], list[tuple]]):
    def build(parameters: dict, base: str):
        def rows(view: View, bound: dict) -> list[tuple]:
            from urllib.parse import quote

            url = parameters.get("url", "") + _placeholder(view.query or "", lambda n: quote(str(bound[n]), safe=""))
            return parse(_read(url if re.match(r"(https?|file):", url) else str(Path(base) / url)), view)

        return rows

    return build


def _mongo(parameters: dict, base: str):
    def rows(view: View, bound: dict) -> list[tuple]:
        pipeline = json.loads(_placeholder(view.query, lambda n: json.dumps(str(bound[n]))[1:-1]))
        if "file" in parameters:  # an exported collection: one document a line, $match and $limit only
            docs = [json.loads(x) for x in _read(str(Path(base) / parameters["file"])).splitlines() if x.strip()]
            for stage in pipeline:
                if "$match" in stage:
                    docs = [d for d in docs if all(d.get(k) == v for k, v in stage["$match"].items())]
                elif "$limit" in stage:
                    docs = docs[: stage["$limit"]]
            return mongo_rows(docs, view)
        import pymongo

        client = pymongo.MongoClient(parameters["url"])
        return mongo_rows(list(client[parameters["database"]][parameters["collection"]].aggregate(pipeline)), view)

    return rows


#: Backends that give rows of strings for a view and its bound placeholders.
BACKENDS: dict[str, Callable | None] = {
    "SQLite": _sqlite,
    "JSONWebAPI": _web(_json_rows),
    "SPARQLEndpoint": _web(sparql_rows),
    "MongoDB": _mongo,
    "SparkSQL": None,
    "PostgreSQL": None,
    "MySQL": None,
    "HSQLDB": None,
}

#: Protocols whose answers are documents that Spark can read itself where they are files.
PARSERS = {"JSONWebAPI": _json_rows, "SPARQLEndpoint": sparql_rows}

# JDBC URL prefixes and driver classes.
JDBC = {
    "PostgreSQL": ("jdbc:postgresql://", "org.postgresql.Driver"),
    "MySQL": ("jdbc:mysql://", "com.mysql.cj.jdbc.Driver"),
    "HSQLDB": ("jdbc:hsqldb:", "org.hsqldb.jdbc.JDBCDriver"),
}


def jdbc_options(protocol: str, parameters: dict) -> dict[str, str]:
    """Options of spark.read.jdbc for a declared database."""
    prefix, driver = JDBC[protocol]
    url = parameters["url"] if parameters["url"].startswith("jdbc:") else prefix + parameters["url"]
    out = {"url": url, "driver": parameters.get("driver", driver)}
    if "user" in parameters:
        out["user"] = parameters["user"]
    if "passwordFile" in parameters:
        out["password"] = Path(parameters["passwordFile"]).read_text(encoding="utf-8").strip()
    elif "password" in parameters:
        out["password"] = parameters["password"]
    return out


def add_views(catalog: Catalog, document: Document, base: str = ".", prefix: str = "") -> list[str]:
    """Register every view as a predicate; the names."""
    names = []
    for view in document.views:
        declared = document.datasources[view.datasource]
        name = f"{prefix}:{view.id}" if prefix else view.id
        catalog.add(name, _source(catalog, view, declared, base), arity=len(view.signature))
        names.append(name)
    return names


def _source(catalog: Catalog, view: View, declared: dict, base: str) -> Source:
    spark, protocol, parameters = catalog.spark, declared.get("protocol"), declared.get("parameters", {})
    mandatory = {i: p.mandatory for i, p in enumerate(view.signature) if p.mandatory}
    policies = [p.missing for p in view.signature]
    if protocol == "SparkSQL":
        if not mandatory:
            df = handle_missing(positional(spark.sql(view.query)), policies, view.id)
            return Source(lambda: df, df.schema, origin="view")
        inner = _placeholder(view.query, lambda n: "b.c" + str(next(i for i, m in mandatory.items() if m == n)))
        probe = spark.sql(_placeholder(view.query, lambda n: "NULL")).schema
        schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(probe.fields)])

        def fetch(bindings: DataFrame) -> DataFrame:
            """A dependent join: the view's query as a lateral subquery of the bindings, under a name of this call's own."""
            name = f"lodestone_bindings_{uuid.uuid4().hex}"
            bindings.createOrReplaceTempView(name)
            inside = ", ".join(f"c{i}" for i in range(len(schema)))
            out = spark.sql(f"SELECT q.* FROM {name} b, LATERAL ({inner}) AS q({inside})")
            spark.catalog.dropTempView(name)  # the plan is resolved
            return handle_missing(out, policies, view.id)

        return Source(None, schema, frozenset(mandatory), fetch, origin="view")
    if protocol in JDBC:
        options = jdbc_options(protocol, parameters)
        df = handle_missing(positional(spark.read.format("jdbc").options(**options, query=view.query).load()), policies, view.id)
        return Source(lambda: df, df.schema, origin="jdbc")
    build = BACKENDS.get(protocol)
    if build is None:
        raise PlanError(f"no backend for {protocol}")
    rows = build(parameters, base)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(view.signature))])

    def typed(df: DataFrame) -> DataFrame:
        return handle_missing(_typed(df, view), policies, view.id)

    fields = typed(spark.createDataFrame([], schema)).schema
    if not mandatory:
        if protocol in PARSERS and not re.match(r"https?:", parameters.get("url", "")):
            path = parameters.get("url", "") + (view.query or "")
            path = path if re.match(r"\w+:", path) or Path(path).is_absolute() else str(Path(base) / path)
            return Source(lambda: typed(_parsed(spark.read.text(path, wholetext=not parameters.get("lines")), view, protocol, schema)), fields, origin="view")

        def run_once(batches):
            for batch in batches:
                for _ in range(len(batch)):
                    yield _frame(rows(view, {}), len(schema))

        # one request, on an executor
        return Source(lambda: typed(spark.range(1).mapInPandas(run_once, schema)), fields, origin="view")

    def fetch_rows(bindings: DataFrame) -> DataFrame:
        """One request per distinct binding, on the executors."""
        order = sorted(mandatory)

        def run(batches):
            for batch in batches:
                out = []
                for values in batch.itertuples(index=False):
                    bound = {mandatory[i]: v for i, v in zip(order, values, strict=True)}
                    for r in rows(view, bound):
                        full = list(r)
                        for i, v in zip(order, values, strict=True):
                            full[i] = _plain(v) if full[i] is None else full[i]
                        out.append(full)
                yield _frame(out, len(schema))

        return typed(bindings.mapInPandas(run, schema))

    return Source(None, fields, frozenset(mandatory), fetch_rows, origin="view")


def _frame(rows: list, width: int) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f"c{i}" for i in range(width)], dtype=object)


def _parsed(texts: DataFrame, view: View, protocol: str, schema: T.StructType) -> DataFrame:
    """Rows of documents that Spark reads, a document in each row."""
    parse = PARSERS[protocol]

    def run(batches):
        for batch in batches:
            yield _frame([r for text in batch["value"] if text and text.strip() for r in parse(text, view)], len(schema))

    return texts.mapInPandas(run, schema)


def _typed(df: DataFrame, view: View) -> DataFrame:
    """Positions in their declared types; `term` tells nodes, IRIs, numbers and truth values from other text."""
    out = []
    for i, p in enumerate(view.signature):
        c = F.col(f"c{i}")
        if p.type == "term":
            number = F.when(c.rlike(r"^[+-]?\d+$"), term_struct("l", c, "integer")).when(c.rlike(r"^[+-]?(\d+\.\d*|\.?\d+)([eE][+-]?\d+)?$"), term_struct("l", c, "double"))
            number = number.when(c.isin("true", "false"), term_struct("l", c, "boolean"))
            node = F.when(c.startswith("_:"), term_struct("n", c)).when(F.lower(c).rlike("^(https?://|urn:)"), term_struct("c", c))
            c = F.when(c.isNotNull(), F.coalesce(node, number, term_struct("c", c)))
        elif p.type != "string":
            c = c.try_cast(p.type)
        out.append(c.alias(f"c{i}"))
    return df.select(*out)
