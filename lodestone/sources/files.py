"""Files of facts: CSV, manifests of CSV files, RDF; and their writers."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.iri import IRIManager
from lodestone.plans.encoding import TERM, PlanError, is_term, term_struct, to_term
from lodestone.runtime import saved
from lodestone.sources.catalog import Catalog, positional
from lodestone.sources.rdf_documents import parse_jsonld, parse_rdfxml
from lodestone.terms import RDF, XSD

RDF_TYPE = RDF + "type"


@dataclass(frozen=True)
class CsvOptions:
    separator: str = ","
    prefix: str = ""
    header_rows: int = 0
    #: Fields may hold line breaks; a file is then read by one task.
    multi_line: bool = False


def _without_headers(rows: DataFrame, columns: list[str], header_rows: int) -> DataFrame:
    """The rows of files without the first `header_rows` of each file, whatever they hold."""
    marked = rows.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = marked.where("block = 0").groupBy("file").agg(F.min("at").alias("first"))
    return marked.join(first, "file", "left").where((F.col("block") > 0) | (F.col("at") - F.col("first") >= header_rows)).select(*columns)


def read_csv(spark: SparkSession, path: str, options: CsvOptions | None = None) -> DataFrame:
    """Rows of a CSV file as string columns; a row of another width raises when it is read."""
    o = options or CsvOptions()
    if o.multi_line:
        given = {"sep": o.separator, "quote": '"', "escape": '"', "multiLine": True, "emptyValue": "", "columnPruning": False}
        probe = spark.read.options(**given).csv(path)
        row = _without_headers(probe, probe.columns, o.header_rows).first() if o.header_rows else probe.first()
        width = max((i + 1 for i, v in enumerate(row or ()) if v is not None), default=1)
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
        rows = spark.read.options(**given, mode="PERMISSIVE" if o.header_rows else "FAILFAST").schema(schema).csv(path)
        return _without_headers(rows, schema.names, o.header_rows) if o.header_rows else rows
    lines = spark.read.text(path)
    if o.header_rows:
        lines = _without_headers(lines, ["value"], o.header_rows)
    first = lines.first()
    width = len(_split_line(first.value if first else "", o.separator))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    parsed = lines.select(F.split_part(F.lit("x"), F.lit("y"), F.lit(1)).alias("_"), F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"sep": o.separator, "mode": "FAILFAST", "emptyValue": ""}).alias("r"), "value")
    counted = parsed.withColumn("n", F.size(F.split(F.regexp_replace("value", r'"(?:[^"]|"")*"', ""), re.escape(o.separator), -1)))
    checked = counted.where(F.when(F.col("n") == width, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("ragged row: "), "value")).cast("boolean")))
    return checked.select(*(F.col(f"r.c{i}").alias(f"c{i}") for i in range(width)))


def _split_line(line: str, separator: str) -> list[str]:
    import csv

    return next(csv.reader([line], delimiter=separator), [])


def csv_predicate(path: str, options: CsvOptions | None = None) -> str:
    return (options.prefix if options else "") + Path(path).stem.lower()


def add_csv(catalog: Catalog, path: str, name: str | None = None, options: CsvOptions | None = None) -> str:
    name = name or csv_predicate(path, options)
    catalog.add(name, read_csv(catalog.spark, path, options))
    return name


_MANIFEST = re.compile(r'@source\s+([^\s\[]+)\s*\[(\d+)\]\s*:\s*load-csv\s*\(\s*"([^"]+)"\s*\)\s*\.')


def read_manifest(path: str) -> list[tuple[str, int, str]]:
    """(predicate, arity, file) of each @source line; files are relative to the manifest."""
    text = Path(path).read_text(encoding="utf-8")
    found = [(m[1], int(m[2]), str(Path(path).parent / m[3])) for m in _MANIFEST.finditer(text)]
    lines = [x for x in text.splitlines() if x.strip() and not x.strip().startswith("%")]
    if len(found) != len(lines):
        raise PlanError("a manifest has @source lines only")
    return found


def add_manifest(catalog: Catalog, path: str, options: CsvOptions | None = None) -> list[str]:
    for name, arity, file in read_manifest(path):
        df = read_csv(catalog.spark, file, options)
        if len(df.columns) != arity:
            raise PlanError(f"{file} has {len(df.columns)} columns, {name} has {arity}")
        catalog.add(name, df)
    return [n for n, _, _ in read_manifest(path)]


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """One predicate as CSV files; terms by their text."""
    flat = [F.col(f"`{f.name}`.v").alias(f.name) if is_term(f.dataType) else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("sep", separator).option("emptyValue", "").csv(path)


def write_csv_facts(catalog: Catalog, path: str, names: Iterable[str] | None = None) -> None:
    keys = [k for k in catalog.sources if names is None or k[0] in set(names)]
    if len(keys) != 1:
        raise PlanError("a CSV file holds one predicate")
    write_csv(catalog.sources[keys[0]].frame(), path)


# RDF
_SUBJECT = r"(<[^>]*>|_:\S+)"
_NTRIPLE = rf'^\s*{_SUBJECT}\s+(<[^>]*>)\s+(<[^>]*>|_:[^\s.]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*({_SUBJECT}\s*)?\.\s*$'


def _unescaped(c):
    """The common escapes of literals; \\u sequences stay."""
    return F.replace(F.replace(F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\\\"), F.lit("\\"))


def _rdf_term(c):
    literal = F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)
    kind = F.regexp_extract(c, r"\^\^<([^>]*)>$", 1)
    local = F.regexp_replace(kind, f"^({re.escape(XSD)}|{re.escape(RDF)})", "")
    lang = F.regexp_extract(c, r'"@([A-Za-z0-9-]+)$', 1)
    text = F.when((local == "") | (local == "string"), term_struct("c", _unescaped(literal))).otherwise(term_struct("l", _unescaped(literal), local))
    text = F.when(lang != "", term_struct("l", _unescaped(literal), "langString", lang)).otherwise(text)
    iri = term_struct("c", F.regexp_extract(c, "^<(.*)>$", 1))
    return F.when(c.startswith("<"), iri).when(c.startswith("_:"), term_struct("n", c)).otherwise(text)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o as TERM from N-Triples or N-Quads; a line that is none raises."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    good = lines.where(F.when(F.col("value").rlike(_NTRIPLE), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no triple: "), "value")).cast("boolean")))
    part = lambda i: F.regexp_extract("value", _NTRIPLE, i)
    return good.select(_rdf_term(part(1)).alias("s"), _rdf_term(part(2)).alias("p"), _rdf_term(part(3)).alias("o"))


_TURTLE = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^>\s]*>)|(?P<long>\"{3}.*?\"{3})|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)
  |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<blank>_:[\w-]+)|(?P<name>[\w-]*:[\w.%-]*[\w%-]|[\w-]*:)|(?P<word>[A-Za-z]+)|(?P<mark>[;,.\[\](){}])""", re.VERBOSE | re.DOTALL)  # fmt: skip


def parse_turtle(text: str, base: str | None = None) -> list[tuple[tuple, tuple, tuple]]:
    """Triples of TERM tuples of a Turtle subset: prefixes, base, ; and , lists, blank nodes, collections; of
    TriG also the triples in graphs, without the graphs' names."""
    tokens, at = [], 0
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise PlanError(f"unexpected {text[at:at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    iris, out, blanks = IRIManager(base), [], iter(range(10**9))
    tokens.append(("end", ""))
    i = 0

    def peek():
        return tokens[i]

    def take(value: str | None = None):
        nonlocal i
        token = tokens[i]
        if value is not None and token[1] != value:
            raise PlanError(f"expected {value!r}, found {token[1]!r}")
        i += 1
        return token

    def iri(token) -> str:
        if token[0] == "iri":
            return iris.create(token[1][1:-1])
        prefix, _, local = token[1].partition(":")
        return iris.create(local, prefix)

    def term() -> tuple:
        kind, value = take()
        if kind in ("iri", "name"):
            return "c", iri((kind, value)), "", ""
        if kind == "blank":
            return "n", value, "", ""
        if kind in ("string", "long"):
            inner = value[3:-3] if kind == "long" else value[1:-1]
            inner = re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), inner)
            if peek()[0] == "lang":
                return "l", inner, "langString", take()[1][1:]
            if peek()[0] == "type":
                take()
                local = re.sub(f"^({re.escape(XSD)}|{re.escape(RDF)})", "", iri(take()))
                return ("c", inner, "", "") if local == "string" else ("l", inner, local, "")
            return "c", inner, "", ""
        if kind == "number":
            return "l", value, "double" if "e" in value.lower() else "decimal" if "." in value else "integer", ""
        if kind == "word" and value in ("true", "false"):
            return "l", value, "boolean", ""
        if kind == "word" and value == "a":
            return "c", RDF_TYPE, "", ""
        if value == "[":
            node = ("n", f"_:b{next(blanks)}", "", "")
            if peek()[1] != "]":
                properties(node)
            take("]")
            return node
        if value == "(":
            items = []
            while peek()[1] != ")":
                items.append(term())
            take(")")
            rest = ("c", RDF + "nil", "", "")
            for item in reversed(items):
                node = ("n", f"_:b{next(blanks)}", "", "")
                out.append((node, ("c", RDF + "first", "", ""), item))
                out.append((node, ("c", RDF + "rest", "", ""), rest))
                rest = node
            return rest
        raise PlanError(f"unexpected {value!r}")

    def properties(subject: tuple) -> None:
        while True:
            predicate = term()
            while True:
                out.append((subject, predicate, term()))
                if peek()[1] != ",":
                    break
                take()
            if peek()[1] != ";":
                return
            while peek()[1] == ";":
                take()
            if peek()[1] in (".", "]", "}"):
                return

    def graph() -> None:
        take("{")
        while peek()[1] != "}":
            subject = term()
            if peek()[1] not in (".", "}"):
                properties(subject)
            if peek()[1] != "}":
                take(".")
        take("}")

    while peek()[0] != "end":
        kind, value = peek()
        if value.lower() in ("@prefix", "prefix"):
            take()
            name = take()[1].rstrip(":")
            iris.set_prefix(name, take()[1][1:-1], relaxed=True)
            if kind == "lang":
                take(".")
        elif value.lower() in ("@base", "base"):
            take()
            iris.set_base(take()[1][1:-1])
            if kind == "lang":
                take(".")
        elif value == "{":
            graph()
        else:
            if (kind, value.lower()) == ("word", "graph"):
                take()
            subject = term()
            if peek()[1] == "{":
                graph()
                continue
            # a blank node may have its properties inside only
            if value != "[" or peek()[1] != ".":
                properties(subject)
            take(".")
    return out


#: Formats that only a whole file makes sense of: one task for each file.
_DOCUMENTS = {".ttl": parse_turtle, ".n3": parse_turtle, ".trig": parse_turtle, ".rdf": parse_rdfxml, ".xml": parse_rdfxml, ".jsonld": parse_jsonld}


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o as TERM from a file or files of one suffix; N-Triples and N-Quads line by line, other formats file by file on the executors."""
    suffix = Path(path).suffix.lower()
    if suffix in (".nt", ".nq"):
        return read_ntriples(spark, path)
    if suffix in _DOCUMENTS:
        parse, names = _DOCUMENTS[suffix], TERM.names
        kind = pa.struct([(n, pa.string()) for n in names])

        def run(batches):
            for batch in batches:
                for text in batch.column("value").to_pylist():
                    rows = parse(text)
                    yield pa.RecordBatch.from_arrays([pa.array([dict(zip(names, r[i], strict=True)) for r in rows], kind) for i in range(3)], names=list("spo"))

        return spark.read.text(path, wholetext=True).mapInArrow(run, T.StructType([T.StructField(n, TERM) for n in "spo"]))
    raise PlanError(f"{suffix} files cannot be read")


def _by_property(triples: DataFrame) -> DataFrame:
    """The triples written once in the order of their properties, so that a scan for one reads its row groups only."""
    return saved(triples.repartitionByRange("p.v", "s.v").sortWithinPartitions("p.v"), "triples")


RDF_MODES = ("raw", "natural", "natural_full")


def add_rdf(catalog: Catalog, triples: DataFrame, mode: str = "natural_full") -> list[str]:
    """Triples as predicates: triple/3, a binary predicate per property, or classes as unary ones too."""
    if mode not in RDF_MODES:
        raise ValueError(f"mode is one of {', '.join(RDF_MODES)}")
    if mode == "raw":
        catalog.add("triple", positional(triples))
        return ["triple"]
    names, triples = [], _by_property(triples)
    # the vocabulary reaches the driver, the triples do not
    for (name,) in triples.select("p.v").distinct().collect():
        own = triples.where(F.col("p.v") == name)
        if mode == "natural_full" and name == RDF_TYPE:
            for (kind,) in own.where("o.k = 'c'").select("o.v").distinct().collect():
                catalog.add(kind, positional(own.where(F.col("o.v") == kind).select("s")))
                names.append(kind)
        else:
            catalog.add(name, positional(own.select("s", "o")))
            names.append(name)
    return names


def triple_store(catalog: Catalog, triples: DataFrame) -> None:
    """Unary and binary predicates looked up in one triples frame on demand."""
    from lodestone.sources.catalog import Source

    triples = _by_property(triples)

    def ask(key):
        name, arity = key
        if arity == 1:
            df = triples.where((F.col("p.v") == RDF_TYPE) & (F.col("o.v") == name)).select(F.col("s").alias("c0"))
        elif arity == 2:
            df = triples.where(F.col("p.v") == name).select(F.col("s").alias("c0"), F.col("o").alias("c1"))
        else:
            return None
        return Source(lambda: df, df.schema, origin="triples")

    catalog.dynamic.append(ask)


def _rdf_text(c):
    escaped = F.replace(F.replace(F.replace(c["v"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    typed = F.concat(F.lit('"'), escaped, F.lit('"'), F.when(c["lang"] != "", F.concat(F.lit("@"), c["lang"])).otherwise(F.concat(F.lit(f"^^<{XSD}"), c["dt"], F.lit(">"))))
    blank = F.when(c["v"].startswith("_:"), c["v"]).otherwise(F.concat(F.lit("_:n"), F.md5(c["v"])))
    constant = F.when(c["v"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"), F.concat(F.lit("<"), c["v"], F.lit(">"))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))
    return F.when(c["k"] == "n", blank).when(c["k"] == "l", typed).otherwise(constant)


def write_ntriples(triples: DataFrame, path: str) -> None:
    cols = [to_term(F.col(n), triples.schema[n].dataType) for n in triples.columns[:3]]
    subject = F.when(cols[0]["k"] == "n", _rdf_text(cols[0])).otherwise(F.concat(F.lit("<"), cols[0]["v"], F.lit(">")))
    predicate = F.concat(F.lit("<"), cols[1]["v"], F.lit(">"))
    triples.select(F.concat_ws(" ", subject, predicate, _rdf_text(cols[2]), F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def as_triples(catalog: Catalog, names: Iterable[str] | None = None) -> DataFrame:
    """Unary and binary predicates as triples; triple/3 as it is."""
    out = None
    for (name, arity), source in catalog.sources.items():
        if names is not None and name not in set(names):
            continue
        df, kinds = source.frame(), [f.dataType for f in source.schema.fields]
        cols = [to_term(F.col(f"c{i}"), k) for i, k in enumerate(kinds)]
        if name == "triple" and arity == 3:
            part = df.select(cols[0].alias("s"), cols[1].alias("p"), cols[2].alias("o"))
        elif arity == 2:
            part = df.select(cols[0].alias("s"), term_struct("c", F.lit(name)).alias("p"), cols[1].alias("o"))
        elif arity == 1:
            part = df.select(cols[0].alias("s"), term_struct("c", F.lit(RDF_TYPE)).alias("p"), term_struct("c", F.lit(name)).alias("o"))
        else:
            raise PlanError(f"{name}/{arity} is no triple")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise PlanError("no predicate to write")
    return out


# the rule language
def write_document(doc, path: str | None = None) -> str:
    """Directives, facts, rules, constraints and queries as text that parses again."""
    iris, lines = doc.iris, []
    if iris.base:
        lines.append(f"@base <{iris.base}>.")
    lines += [f"@prefix {p}: <{n}>." for p, n in sorted(iris.prefixes.items())]
    lines += [f"@computed {p}: <{t}>." for p, t in sorted(doc.computed.items())]
    for title, items in (("@facts", [f"{f}." for f in doc.facts]), ("@rules", doc.rules), ("@constraints", doc.constraints), ("@queries", doc.queries)):
        if items:
            lines += [title, *sorted(map(str, items))]
    text = "\n".join(lines) + "\n"
    if path:
        Path(path).write_text(text, encoding="utf-8")
    return text


def write_facts(df: DataFrame, pred: str, path: str) -> None:
    """One predicate's rows as fact lines, distributed."""
    def shown(name: str, t: T.DataType):
        c = F.col(f"`{name}`")
        if is_term(t):
            null = F.concat(F.lit("_N"), F.md5(c["v"]))
            return F.when(c["k"] == "n", null).when(c["k"] == "l", F.concat(F.lit('"'), c["v"], F.lit('"^^xsd:'), c["dt"])).otherwise(F.concat(F.lit("<"), c["v"], F.lit(">")))
        return F.concat(F.lit('"'), c, F.lit('"')) if isinstance(t, T.StringType) else c.cast("string")

    parts = [shown(f.name, f.dataType) for f in df.schema.fields]
    df.select(F.concat(F.lit(f"{pred}("), F.concat_ws(", ", *parts), F.lit(").")).alias("value")).write.mode("overwrite").text(path)


# formats and imports
_SUFFIXES = {".dlgpe": "dlgpe", ".dlgp": "dlgpe", ".csv": "csv", ".rls": "rls", ".nt": "rdf", ".nq": "rdf", ".ttl": "rdf", ".n3": "rdf", ".rdf": "rdf", ".xml": "rdf", ".jsonld": "rdf", ".trig": "rdf", ".vd": "views", ".json": "computed"}


def detect_format(path: str, sample: str | None = None) -> str:
    """By suffix, else by content; the rule language if nothing tells."""
    suffix = Path(path).suffix.lower()
    if suffix in _SUFFIXES:
        return _SUFFIXES[suffix]
    text = sample if sample is not None else (Path(path).read_text(encoding="utf-8", errors="replace")[:2000] if Path(path).exists() else "")
    if re.search(r"@source\s+\S+\[\d+\]", text):
        return "rls"
    if re.search(r"^\s*(<[^>]+>|_:\S+)\s+<[^>]+>\s+.*\.\s*$", text, re.MULTILINE) or re.search(r"^@prefix\s+\S*:\s*<[^>]*>\s*\.", text, re.MULTILINE) and ":-" not in text and "(" not in text:
        return "rdf"
    first = text.strip().splitlines()[:1]
    if first and "," in first[0] and "(" not in first[0] and not first[0].startswith(("%", "@", "?")):
        return "csv"
    return "dlgpe"


_PARSERS: dict = {}
_WRITERS: dict = {}


def register_parser(name: str, function) -> None:
    _PARSERS[name] = function


def parser(name: str):
    if name not in _PARSERS:
        raise KeyError(f"no parser for {name}")
    return _PARSERS[name]


def register_writer(name: str, function) -> None:
    _WRITERS[name] = function


def writer(name: str):
    if name not in _WRITERS:
        raise KeyError(f"no writer for {name}")
    return _WRITERS[name]


def resolve_imports(path: str, seen: set[str] | None = None) -> list[str]:
    """Files that a document imports, depth first, each once, the document itself last."""
    from lodestone.parser import parse

    seen = set() if seen is None else seen
    own = str(Path(path).resolve())
    if own in seen:
        return []
    seen.add(own)
    out = []
    if detect_format(own) == "dlgpe":
        for target in parse(Path(own).read_text(encoding="utf-8"), relaxed=True).imports:
            if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", target) and not target.startswith("file:"):
                raise PlanError(f"cannot import {target}")
            target = target.removeprefix("file://")
            out += resolve_imports(str(Path(target) if Path(target).is_absolute() else Path(own).parent / target), seen)
    return [*out, own]


register_parser("csv", add_csv)
register_parser("rls", add_manifest)
register_parser("rdf", lambda catalog, path, mode="natural_full": add_rdf(catalog, read_rdf(catalog.spark, path), mode))
register_writer("csv", write_csv_facts)
register_writer("rdf", lambda catalog, path, names=None: write_ntriples(as_triples(catalog, names), path))
register_writer("dlgpe", write_document)
