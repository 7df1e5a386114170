"""IRI references: parse, resolve, relativise, normalise (RFC 3987, RFC 3986 sections 5 and 6)."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, replace

# Fixed value: the reference pattern of RFC 3986, appendix B.
_REFERENCE = re.compile(r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.DOTALL)
_UNRESERVED = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}


@dataclass(frozen=True)
class IRI:
    scheme: str | None
    authority: str | None
    path: str
    query: str | None
    fragment: str | None

    @classmethod
    def parse(cls, text: str) -> IRI:
        m = _REFERENCE.match(text)
        if m[1] is not None and not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.\-]*", m[1]):
            return cls(None, None, text, None, None)
        return cls(m[1], m[2], m[3], m[4], m[5])

    def __str__(self) -> str:
        out = f"{self.scheme}:" if self.scheme is not None else ""
        out += f"//{self.authority}" if self.authority is not None else ""
        out += self.path
        out += f"?{self.query}" if self.query is not None else ""
        return out + (f"#{self.fragment}" if self.fragment is not None else "")

    @property
    def is_absolute(self) -> bool:
        return self.scheme is not None

    def resolve(self, reference: str | IRI) -> IRI:
        """Strict resolution of a reference against this base."""
        ref = IRI.parse(reference) if isinstance(reference, str) else reference
        if ref.scheme is not None:
            return replace(ref, path=without_dots(ref.path))
        if ref.authority is not None:
            return replace(ref, scheme=self.scheme, path=without_dots(ref.path))
        if not ref.path:
            return IRI(self.scheme, self.authority, self.path, self.query if ref.query is None else ref.query, ref.fragment)
        if ref.path.startswith("/"):
            path = ref.path
        elif self.authority is not None and not self.path:
            path = "/" + ref.path
        else:
            path = self.path[: self.path.rfind("/") + 1] + ref.path
        return IRI(self.scheme, self.authority, without_dots(path), ref.query, ref.fragment)

    def relativise(self, target: str | IRI) -> IRI:
        """A short reference that resolves to the target again; the target itself if there is none."""
        goal = IRI.parse(target) if isinstance(target, str) else target
        if goal.scheme != self.scheme:
            return goal
        if goal.authority != self.authority:
            return replace(goal, scheme=None) if goal.authority is not None else goal
        options = []
        if goal.path == self.path:
            if goal.query == self.query and goal.fragment is not None:
                options.append(IRI(None, None, "", None, goal.fragment))
            if goal.query is not None:
                options.append(IRI(None, None, "", goal.query, goal.fragment))
        here, there = self.path.split("/")[:-1], goal.path.split("/")
        same = 0
        while same < min(len(here), len(there) - 1) and here[same] == there[same]:
            same += 1
        if same or not here:
            tail = "../" * (len(here) - same) + "/".join(there[same:])
            if ":" in tail.split("/")[0] or not tail or tail.startswith("/"):
                tail = "./" + tail
            options.append(IRI(None, None, tail, goal.query, goal.fragment))
        options += [replace(goal, scheme=None, authority=None), replace(goal, scheme=None)]
        good = [o for o in options if self.resolve(str(o)) == goal]
        return min(good, key=lambda o: len(str(o)), default=goal)


def without_dots(path: str) -> str:
    """The path without . and .. segments."""
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == ".":
            if last:
                out.append("")
        elif part == "..":
            if len(out) > 1 or (out and out[0]):
                out.pop()
            if last:
                out.append("")
        else:
            out.append(part)
    joined = "/".join(out)
    return joined if not path.startswith("/") or joined.startswith("/") else "/" + joined


def _percents(text: str) -> str:
    """Escapes in upper case; those of unreserved characters decoded."""
    return re.sub(r"%([0-9A-Fa-f]{2})", lambda m: c if (c := chr(int(m[1], 16))) in _UNRESERVED else m[0].upper(), text)


def _percents_of_any_script(text: str) -> str:
    """Escapes in upper case; runs that are UTF-8 of letters and digits of any script decoded too."""

    def decoded(m: re.Match) -> str:
        try:
            plain = bytes.fromhex(m[0].replace("%", "")).decode("utf-8")
        except UnicodeDecodeError:
            return m[0].upper()
        return "".join(c if c in _UNRESERVED or ord(c) >= 0xA0 and c.isalnum() else "".join(f"%{b:02X}" for b in c.encode()) for c in plain)

    return re.sub(r"(?:%[0-9A-Fa-f]{2})+", decoded, text)


def _string(iri: IRI) -> IRI:
    return iri


def _character(iri: IRI) -> IRI:
    return IRI.parse(unicodedata.normalize("NFC", str(iri)))


def _case(iri: IRI) -> IRI:
    return replace(iri, scheme=iri.scheme and iri.scheme.lower(), authority=iri.authority and _lower_host(iri.authority))


def _each_part(change: Callable[[str], str]) -> Callable[[IRI], IRI]:
    return lambda iri: replace(iri, path=change(iri.path), query=iri.query and change(iri.query), fragment=iri.fragment and change(iri.fragment))


def _path(iri: IRI) -> IRI:
    return replace(iri, path=without_dots(iri.path)) if iri.scheme else iri


def _scheme(iri: IRI) -> IRI:
    """Default ports and empty paths."""
    if iri.authority is None:
        return iri
    host, _, port = iri.authority.rpartition(":")
    return replace(iri, authority=host if host and (port == _PORTS.get(iri.scheme or "") or port == "") else iri.authority, path=iri.path or "/")


_SYNTAX = ("character", "case", "percent", "path")
#: What each name stands for: itself, or the steps it is made of.
NORMALISATIONS = {"string": ("string",), "case": ("case",), "character": ("character",), "percent": ("percent",), "path": ("path",), "syntax": _SYNTAX, "scheme": (*_SYNTAX, "scheme")}


@dataclass(frozen=True)
class Normaliser:
    """Normalisations one after another; `extended` decodes escapes of letters of any script, not of ASCII only."""

    steps: tuple[str, ...] = _SYNTAX
    extended: bool = False

    @classmethod
    def of(cls, *kinds: str, extended: bool = False) -> Normaliser:
        if unknown := [k for k in kinds if k not in NORMALISATIONS]:
            raise ValueError(f"no normalisation {', '.join(unknown)}")
        return cls(tuple(dict.fromkeys(s for k in kinds for s in NORMALISATIONS[k])), extended)

    def __add__(self, other: Normaliser) -> Normaliser:
        return Normaliser(tuple(dict.fromkeys((*self.steps, *other.steps))), self.extended or other.extended)

    def __call__(self, text: str | IRI) -> str:
        made = {"string": _string, "character": _character, "case": _case, "path": _path, "scheme": _scheme, "percent": _each_part(_percents_of_any_script if self.extended else _percents)}
        iri = IRI.parse(text) if isinstance(text, str) else text
        for step in self.steps:
            iri = made[step](iri)
        return str(iri)


def normalise(text: str, kind: str = "syntax") -> str:
    """One normalisation, or "syntax": character, case, percent and path together; "scheme" adds default ports and empty paths."""
    return Normaliser.of(kind)(text)


# plain functions over texts
def is_absolute(text: str) -> bool:
    return IRI.parse(text).is_absolute


def resolve(reference: str, base: str | None) -> str:
    """The reference against a base; without a base it stays as it is."""
    return str(IRI.parse(base).resolve(reference)) if base else reference


def _lower_host(authority: str) -> str:
    user, at, host = authority.rpartition("@")
    return user + at + host.lower()


def prepare(text: str, unescape: str | None = None) -> str:
    """Text as found in a document: surrounding space goes, HTML or XML escapes too if named."""
    text = text.strip()
    if unescape == "html":
        return html.unescape(text)
    if unescape == "xml":
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            text = text.replace(name, char)
    return text


class IRIManager:
    """Base and prefixes of a document."""

    def __init__(self, base: str | None = None):
        self.base = IRI.parse(base) if base else None
        self.prefixes: dict[str, str] = {}

    def set_base(self, text: str) -> None:
        self.base = self.base.resolve(text) if self.base else IRI.parse(text)

    def set_prefix(self, name: str, text: str, relaxed: bool = False) -> None:
        iri = IRI.parse(text)
        if not iri.is_absolute and self.base is None and not relaxed:
            raise ValueError(f"the prefix {name} is relative and there is no base")
        self.prefixes[name] = str(self.base.resolve(iri)) if self.base and not iri.is_absolute else text

    def create(self, text: str, prefix: str | None = None) -> str:
        if prefix is not None:
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix}")
            return self.prefixes[prefix] + text
        return str(self.base.resolve(text)) if self.base else text

    def relativise(self, iri: str) -> str:
        """The shortest of prefixed name, relative reference and the IRI itself, each in its notation."""
        options = [f"<{iri}>"]
        options += [f"{p}:{iri[len(n):]}" for p, n in self.prefixes.items() if n and iri.startswith(n) and re.fullmatch(r"[A-Za-z0-9_]+", iri[len(n) :])]
        if self.base:
            options.append(f"<{self.base.relativise(iri)}>")
        return min(options, key=len)
