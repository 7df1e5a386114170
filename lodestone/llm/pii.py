"""Personal data replaced by format-preserving Feistel pseudonyms.

Finders propose numbers, dates, addresses and keys; validators (Luhn, mod 97, octets, calendar,
dialling plan) decide.  A found value is read as an integer of its format's domain,
permuted by a keyed Feistel network with cycle walking, and written back in the same
format, so a card stays a valid card and a date a date.  The permutation depends on the key and
the kind only: equal values have equal pseudonyms in every document, without any lookup
table or shuffle.

Only rows with a digit, an @ or the first letters of a key or of a secret's name reach the
finders; no finder can match in the others, which pass unchanged.  Whole texts
are searched.  A card may stand beside further digits (security code, expiry) behind a space or
hyphen.  Separators inside numbers are kept and do not change the pseudonym.

Defined results: null text stays null; empty texts, repeated rows and extra columns pass
through; a value may be its own pseudonym, with a chance of one in its domain's size.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sampling import column, quoted, unused

#: For tests and demonstrations; production passes a secret key.
DEMO_KEY = b"lodestone-demonstration-key"
ROUNDS = 8

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    """A keyed permutation of 0..size-1 for any size and kind of value."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: bytes, turn: int, half: int, bits: int) -> int:
        data = kind + bytes([turn]) + half.to_bytes((bits + 7) // 8 or 1, "little")
        out = hashlib.blake2b(data, key=self.key, digest_size=max(8, (bits + 7) // 8)).digest()
        return int.from_bytes(out, "little") & ((1 << bits) - 1)

    def _once(self, kind: bytes, value: int, bits: int, turns) -> int:
        left, right = value >> bits, value & ((1 << bits) - 1)
        for turn in turns:
            left, right = right, left ^ self._round(kind, turn, right, bits)
        return right << bits | left

    def permute(self, value: int, size: int, kind: str) -> int:
        if size < 2:
            return value
        bits = ((size - 1).bit_length() + 1) // 2
        tweak = f"{kind}/{size}".encode()
        out = value
        while True:
            out = self._once(tweak, out, bits, range(ROUNDS))
            if out < size:
                return out

    def restore(self, value: int, size: int, kind: str) -> int:
        """The inverse of permute."""
        if size < 2:
            return value
        bits = ((size - 1).bit_length() + 1) // 2
        tweak = f"{kind}/{size}".encode()
        out = value
        while True:
            out = self._once(tweak, out, bits, range(ROUNDS - 1, -1, -1))
            if out < size:
                return out


def luhn_digit(body: str) -> str:
    """The check digit that makes body + digit valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _mixed(text: str, alphabets: list[str]) -> tuple[int, int]:
    value, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        value = value * len(a) + a.index(c)
        size *= len(a)
    return value, size


def _unmixed(value: int, alphabets: list[str]) -> str:
    out = []
    for a in reversed(alphabets):
        value, d = divmod(value, len(a))
        out.append(a[d])
    return "".join(reversed(out))


def _spread(fe: Feistel, text: str, alphabets: list[str], kind: str) -> str:
    value, size = _mixed(text, alphabets)
    return _unmixed(fe.permute(value, size, kind), alphabets)


def _refill(shape: str, digits: str) -> str:
    """The digits in the places of the shape's digits."""
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in shape)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _card(fe: Feistel, text: str) -> str | None:
    d = _only_digits(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = _spread(fe, d[1:-1], [_DIGITS] * (len(d) - 2), f"card{d[0]}")
    return _refill(text, d[0] + body + luhn_digit(d[0] + body))


def _phone(fe: Feistel, text: str) -> str | None:
    d = _only_digits(text)
    if text[0] == "+":
        if not 8 <= len(d) <= 15 or d[0] == "0":
            return None
        # the country code's first digit stays
        return _refill(text, d[0] + _spread(fe, d[1:], [_DIGITS] * (len(d) - 1), "phone"))
    if len(d) != 10 or d[0] in "01" or d[3] in "01":
        return None
    lead = "23456789"
    return _refill(text, _spread(fe, d, [lead, _DIGITS, _DIGITS, lead, *[_DIGITS] * 6], "national phone"))


def _octets(fe: Feistel, text: str) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, fe.permute(value, 1 << 32, "ip").to_bytes(4, "big")))


def _social(fe: Feistel, text: str) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value = fe.permute(value, 898 * 99 * 9999, "social")
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban(fe: Feistel, text: str) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _spread(fe, plain[4:], [_DIGITS if c in _DIGITS else _LETTERS.upper() for c in plain[4:]], "iban" + plain[:2])
    whole = plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body
    it = iter(whole)
    return "".join(c if c == " " else next(it) for c in text)


def _date(fe: Feistel, text: str) -> str | None:
    mark = next(c for c in text if c not in _DIGITS)
    parts = text.split(mark)
    year_first = len(parts[0]) == 4
    y, m, d = map(int, parts if year_first else reversed(parts))
    us = not year_first and mark == "/" and m > 12 >= d
    if us:
        m, d = d, m
    try:
        day = datetime.date(y, m, d).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = datetime.date.fromordinal(_FIRST_DAY + fe.permute(day, _DAYS, "date"))
    values = [new.year, new.month, new.day] if year_first else [new.month, new.day, new.year] if us else [new.day, new.month, new.year]
    return mark.join(str(v).zfill(len(p)) for v, p in zip(values, parts, strict=True))


def _by_class(fe: Feistel, text: str, kind: str) -> str:
    """Letters go to letters of their case and digits to digits; other characters stay."""
    chosen = [(i, _DIGITS if c in _DIGITS else _LETTERS if c in _LETTERS else _LETTERS.upper()) for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    new = _spread(fe, "".join(text[i] for i, _ in chosen), [a for _, a in chosen], f"{kind}{''.join('d' if a == _DIGITS else a[0] for _, a in chosen)}")
    out = list(text)
    for (i, _), c in zip(chosen, new, strict=True):
        out[i] = c
    return "".join(out)


def _email(fe: Feistel, text: str) -> str | None:
    local, _, domain = text.rpartition("@")
    name, _, end = domain.rpartition(".")
    return f"{_by_class(fe, local, 'email')}@{_by_class(fe, name, 'domain')}.{end}"


def _hex(fe: Feistel, text: str) -> str | None:
    upper = text != text.lower()
    alphabet = _DIGITS + ("ABCDEF" if upper else "abcdef")
    if any(c not in alphabet for c in text):
        return _by_class(fe, text, "secret")
    return _spread(fe, text, [alphabet] * len(text), "secret")


def _key_id(fe: Feistel, text: str) -> str | None:
    return text[:4] + _spread(fe, text[4:], [_LETTERS.upper() + _DIGITS] * (len(text) - 4), "key id")


# Finders in order of precedence: (kind, pattern with the value as group "v", pseudonym).
_KINDS: tuple[tuple[str, str, Callable[[Feistel, str], str | None]], ...] = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", _email),
    ("key_id", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", _key_id),
    ("secret", r"(?i:\b(?:token|password|passwd|secret|api_?key)\b[\"']?\s{0,2}[=:]\s{0,2}[\"']?)(?P<secret_v>[A-Za-z0-9_\-]{8,})", _hex),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    ("date", r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d\-/]|\.\d)", _date),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _octets),
    ("social", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", _social),
    ("phone", r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,5}(?:[ .\-]\d{2,5}){1,4}(?!\d)|\+\d{8,15}(?!\d)|(?<![\d\-])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])", _phone),
    ("card", r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)", _card),
)
KINDS = tuple(k for k, _, _ in _KINDS)
#: Kinds of digits: only ASCII digits make their values.
_NUMBERS = ("iban", "date", "ip", "social", "phone", "card")
_FINDER = re.compile("|".join(f"(?P<{k}>(?a:{p}))" if k in _NUMBERS else f"(?P<{k}>{p})" for k, p, _ in _KINDS))
_MAKERS = {k: f for k, _, f in _KINDS}
#: What every match of a finder holds, for Arrow's regular expressions.
_NEEDED = r"[0-9@]|(?i:token|passw|secret|api_?key)|AKIA|ASIA"


def pseudonymise(fe: Feistel, text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each in the new text."""
    out, spans, at, grown = [], [], 0, 0
    place = 0
    while match := _FINDER.search(text, place):
        kind = next(k for k in KINDS if match.group(k) is not None)
        start, end = match.span("secret_v" if kind == "secret" else kind)
        old = text[start:end]
        new = _MAKERS[kind](fe, old)
        if new is None and kind == "card" and (shorter := _card_within(fe, old)):
            old, end = shorter, start + len(shorter)
            new = _card(fe, old)
        if new is None:
            place = _next_place(text, match)
            continue
        out += [text[at:start], new]
        spans.append((kind, start + grown, len(new)))
        grown += len(new) - len(old)
        at = place = end
    out.append(text[at:])
    return "".join(out), spans


#: Digits of each group of cards as usually written.
_LAYOUTS = re.compile(r"1[3-9]|(?:4 ){3}[1-4]|(?:4 ){4}[1-3]|4 6 [45]")


def _card_within(fe: Feistel, text: str) -> str | None:
    """The card at the start of a refused run of digit groups, if no better one begins at a later group.

    Cards end at group borders; usual layouts go before others, then the longest and the first.
    """
    groups = list(re.finditer(r"\d+", text))
    best = None
    for i, first in enumerate(groups):
        for j in range(i, len(groups)):
            value = text[first.start() : groups[j].end()]
            if _card(fe, value) is not None:
                layout = " ".join(str(len(g[0])) for g in groups[i : j + 1])
                rank = (_LAYOUTS.fullmatch(layout) is not None, len(_only_digits(value)), -i)
                best = max(best or (rank, i, value), (rank, i, value))
    return best[2] if best and best[1] == 0 else None


def _next_place(text: str, match: re.Match) -> int:
    """Behind the first run of letters and digits of a refused match: nothing inside it begins anew."""
    place = match.start() + 1
    while place < match.end() and text[place - 1].isalnum() and text[place].isalnum():
        place += 1
    return place


def _replace(key: bytes, names: list[str], spans_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fe = Feistel(key)
        for batch in batches:
            column = batch.column("text")
            needed = pc.match_substring_regex(column, _NEEDED).to_pylist()
            texts, found = None, [[] for _ in range(batch.num_rows)]
            for i in range(batch.num_rows):
                if needed[i]:
                    new, spans = pseudonymise(fe, column[i].as_py())
                    if spans:
                        texts = texts if texts is not None else column.to_pylist()
                        texts[i] = new
                        found[i] = [{"kind": k, "first": a, "length": n} for k, a, n in spans]
            spans = pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("length", pa.int32())])))
            columns = [(column if texts is None else pa.array(texts, pa.string())) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, spans], names=[*names, spans_name])

    return run


def session_key(spark) -> bytes:
    """The secret in the session's `lodestone.pii.key`; the demonstration key where it is unset, as in tests."""
    named = spark.conf.get("lodestone.pii.key", None)
    return named.encode() if named else DEMO_KEY


def replace_pii(docs: DataFrame, key: bytes, spans_as: str | None = "pii_spans") -> DataFrame:
    """docs with pseudonyms in text, its length in n_chars if there, and the spans as a last column.

    The spans have the name `spans_as`, with underscores before it if the input has a column of that name.
    """
    names = docs.columns
    spans = unused(names, spans_as or "__pii_spans")
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(_replace(key, names, spans), f"{fields}, {quoted(spans)} array<struct<kind:string,first:int,length:int>>")
    if "n_chars" in names:
        changed = F.when(F.size(column(spans)) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", changed.otherwise(F.col("n_chars")))
    return out if spans_as else out.drop(column(spans))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = replace_pii(docs, session_key(spark))
    return found.selectExpr("doc_id", "text", "cast(size(pii_spans) AS long) AS n_pii", "array_join(array_sort(array_distinct(pii_spans.kind)), ',') AS kinds")
