"""Terms of the rule language and typed literal values."""

from __future__ import annotations

import datetime
import decimal
import re
from dataclasses import dataclass, field

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    name: str

    def __str__(self) -> str:
        return self.name if re.fullmatch(r"[a-z][A-Za-z0-9_]*", self.name) else f"<{self.name}>"


@dataclass(frozen=True)
class Lit:
    """A typed literal: identity is (datatype, value, language), so 1, 1.0 and "1" differ and "01"^^integer is 1."""

    value: object
    datatype: str = "string"
    lang: str | None = None
    lexical: str | None = field(default=None, compare=False)

    def __str__(self) -> str:
        if self.datatype == "string":
            return '"' + str(self.value) + '"'
        if self.datatype == "boolean":
            return str(self.value).lower()
        if self.datatype in ("integer", "decimal", "double") and self.lexical is None:
            return repr(self.value) if self.datatype != "integer" else str(self.value)
        return self.lexical if self.datatype in ("integer", "decimal", "double") else f'"{unparse(self)}"^^xsd:{self.datatype}'


@dataclass(frozen=True)
class Null:
    """A labelled null: known to exist, equal to itself only."""

    name: str

    def __str__(self) -> str:
        return "_N" + re.sub(r"\W", "_", self.name)


@dataclass(frozen=True)
class Func:
    """A functional term, evaluable if its name has a function prefix, else uninterpreted."""

    name: str
    args: tuple
    evaluable: bool = True

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


Term = Var | Const | Lit | Null | Func


def variables_of(term: Term) -> list[Var]:
    if isinstance(term, Var):
        return [term]
    return [v for a in term.args for v in variables_of(a)] if isinstance(term, Func) else []


def is_ground(term: Term) -> bool:
    return not variables_of(term)


@dataclass(frozen=True)
class Duration:
    """A duration with separate months and seconds; equality only."""

    months: int
    seconds: decimal.Decimal


_INTEGERS = frozenset(
    "integer long int short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split()
)
_FLOATS = frozenset(["decimal", "float", "double"])
_GREGORIAN = {
    "gYear": r"-?\d{4,}",
    "gYearMonth": r"-?\d{4,}-\d{2}",
    "gMonthDay": r"--\d{2}-\d{2}",
    "gDay": r"---\d{2}",
    "gMonth": r"--\d{2}",
}
_ZONE = r"(Z|[+-]\d{2}:\d{2})?"
_LISTS = ("NMTOKENS", "IDREFS", "ENTITIES")


def local_name(datatype: str) -> str:
    for prefix in (XSD, RDF, "xsd:", "rdf:"):
        if datatype.startswith(prefix):
            return datatype[len(prefix) :]
    return datatype


def _duration(text: str) -> Duration:
    m = re.fullmatch(r"(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if not m or text.endswith(("P", "T")):
        raise ValueError(text)
    sign = -1 if m[1] else 1
    y, mo, d, h, mi = (int(m[i] or 0) for i in range(2, 7))
    seconds = decimal.Decimal(m[7] or 0) + 60 * mi + 3600 * h + 86400 * d
    return Duration(sign * (12 * y + mo), sign * seconds)


def parse_value(lexical: str, kind: str, decimals: bool = False) -> object:
    """The value of a lexical form; raises ValueError if it has none."""
    text = lexical.strip()
    if kind in _INTEGERS:
        if not re.fullmatch(r"[+-]?\d+", text):
            raise ValueError(lexical)
        return int(text)
    if kind in _FLOATS:
        return decimal.Decimal(text) if decimals and kind == "decimal" else float(text.replace("INF", "inf"))
    if kind == "boolean":
        return {"true": True, "1": True, "false": False, "0": False}[text.lower()] if text.lower() in ("true", "1", "false", "0") else _refuse(lexical)
    if kind in ("dateTime", "dateTimeStamp"):
        return datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))
    if kind == "date":
        return datetime.date.fromisoformat(text[:10])
    if kind == "time":
        return datetime.time.fromisoformat(text.replace("Z", "+00:00"))
    if kind in ("duration", "yearMonthDuration", "dayTimeDuration"):
        return _duration(text)
    if kind in _GREGORIAN:
        return text if re.fullmatch(_GREGORIAN[kind] + _ZONE, text) else _refuse(lexical)
    if kind == "hexBinary":
        return bytes.fromhex(text)
    if kind == "base64Binary":
        import base64

        return base64.b64decode(text, validate=True)
    if kind in ("QName", "NOTATION"):
        prefix, _, name = text.rpartition(":")
        return (prefix, name)
    if kind in _LISTS:
        return tuple(text.split())
    return lexical


def _refuse(text: str):
    raise ValueError(text)


def literal(lexical: str, datatype: str = "string", lang: str | None = None, decimals: bool = False, keep_raw: bool = False) -> Lit:
    """A literal from its lexical form; without a value it stays a raw string of its datatype."""
    kind = local_name(datatype)
    if keep_raw:
        return Lit(lexical, kind, lang, lexical)
    try:
        value = parse_value(lexical, kind, decimals)
    except (ValueError, decimal.InvalidOperation):
        value = lexical
    return Lit(value, kind, lang, lexical)


def unparse(lit: Lit) -> str:
    """A canonical lexical form."""
    v = lit.value
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, bytes):
        import base64

        return v.hex().upper() if lit.datatype == "hexBinary" else base64.b64encode(v).decode()
    if isinstance(v, tuple):
        return " ".join(v) if lit.datatype in _LISTS else ":".join(x for x in v if x)
    if isinstance(v, (datetime.date, datetime.time)):
        return v.isoformat()
    if isinstance(v, Duration):
        return lit.lexical or f"P{v.months}MT{v.seconds}S"
    return str(v)


def from_python(value: object) -> Term:
    """The literal (or term) that a Python value stands for."""
    if isinstance(value, (Var, Const, Lit, Null, Func)):
        return value
    if isinstance(value, bool):
        return Lit(value, "boolean")
    if isinstance(value, int):
        return Lit(value, "integer")
    if isinstance(value, decimal.Decimal):
        return Lit(float(value), "decimal")
    if isinstance(value, float):
        return Lit(value, "double")
    if isinstance(value, datetime.datetime):
        return Lit(value, "dateTime")
    if isinstance(value, datetime.date):
        return Lit(value, "date")
    if isinstance(value, datetime.time):
        return Lit(value, "time")
    if isinstance(value, bytes):
        return Lit(value, "hexBinary")
    return Lit(value if isinstance(value, str) else str(value), "string")
