"""Format-preserving pseudonyms of personal data by a keyed Feistel network.

A value is found by its pattern and accepted only if it validates (check
digits, ranges, calendar).  It becomes a number below the count of values its format
allows, is permuted by a Feistel network over that range, and is written
back in the same format: a card number stays a valid card number with its
separators, a date a date.  Equal values of a kind get equal pseudonyms in every document, under one key.

Kinds: card (Luhn), iban (mod 97), ssn, phone (last ten digits; also in international and trunk groups), ipv4, date
(1900 to 2099, ``y-m-d``, ``d/m/y``, ``d.m.y``, and ``m/d/y`` where it can be no ``d/m/y``), email (local part), and
``name=value`` secrets with a digit or of 12 characters, whose name may hold more word characters, and access keys (letters and digits within their classes).
Days to the 12th and later days are permuted apart, so that a date keeps the one reading its format allows.

The key is an argument without a default: who has it can undo the pseudonyms.

Defined cases: null text stays null with counts of 0; empty texts stay
empty; repeated rows get equal results; other columns pass through, columns
named like the counts are replaced where counts are asked for.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import math
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.llm.shared import columns

ROUNDS = 10


class Feistel:
    """Keyed permutations of ranges 0 .. size - 1."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, number: int, half: int, modulus: int) -> int:
        width = (modulus.bit_length() + 7) // 8 + 8
        seed = b"%b|%d|%d|%d" % (tweak, modulus, number, half)
        out = b""
        while len(out) < width:
            out += hashlib.blake2b(seed + b"|%d" % len(out), key=self.key).digest()
        return int.from_bytes(out[:width], "big") % modulus

    def permute(self, value: int, size: int, tweak: str) -> int:
        """Alternating halves of a rectangle a * b >= size; values beyond the size walk on."""
        if size < 2:
            return value
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        name = f"{tweak}|{size}".encode()
        while True:
            x, y = divmod(value, b)
            for number in range(0, ROUNDS, 2):
                x = (x + self._round(name, number, y, a)) % a
                y = (y + self._round(name, number + 1, x, b)) % b
            value = x * b + y
            if value < size:
                return value


def luhn_digit(body: str) -> str:
    total = sum(n if i % 2 else sum(divmod(2 * n, 10)) for i, n in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    new = iter(digits)
    return re.sub("[0-9]", lambda _: next(new), shape)


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _number(f: Feistel, digits: str, kind: str) -> str:
    return str(f.permute(int(digits), 10 ** len(digits), kind)).zfill(len(digits))


def card(f: Feistel, text: str) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = _number(f, digits[:-1], "card")
    return _fill(text, body + luhn_digit(body))


def phone(f: Feistel, text: str) -> str | None:
    digits = _digits(text)
    if not 10 <= len(digits) <= 15 or len(set(digits[-10:])) == 1:
        return None
    return _fill(text, digits[:-10] + _number(f, digits[-10:], "phone"))


def ssn(f: Feistel, text: str) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    index = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    index, serial = divmod(f.permute(index, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(index, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def ipv4(f: Feistel, text: str) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ipv4")
    return ".".join(map(str, value.to_bytes(4, "big")))


YEARS = range(1900, 2100)
_MONTHS = [(y, m) for y in YEARS for m in range(1, 13)]
#: Days after the 12th before each month of ``YEARS``.
_LATE = [0]
for _y, _m in _MONTHS:
    _LATE.append(_LATE[-1] + calendar.monthrange(_y, _m)[1] - 12)


def permuted_date(f: Feistel, day: datetime.date) -> datetime.date:
    month = (day.year - YEARS[0]) * 12 + day.month - 1
    if day.day <= 12:
        month, number = divmod(f.permute(month * 12 + day.day - 1, 12 * len(_MONTHS), "date"), 12)
        return datetime.date(*_MONTHS[month], number + 1)
    late = f.permute(_LATE[month] + day.day - 13, _LATE[-1], "date late")
    month = bisect_right(_LATE, late) - 1
    return datetime.date(*_MONTHS[month], 13 + late - _LATE[month])


def date(f: Feistel, text: str) -> str | None:
    mark = re.search("[^0-9]", text)[0]
    first, second, last = map(int, text.split(mark))
    readings = {"-": [(first, second, last)], "/": [(last, second, first), (last, first, second)], ".": [(last, second, first)]}[mark]
    for american, (year, month, day) in enumerate(readings):
        if year in YEARS and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]:
            new = permuted_date(f, datetime.date(year, month, day))
            if mark == "-":
                return new.isoformat()
            # a day or month of one figure is written with two
            return f"{new.month:02d}{mark}{new.day:02d}{mark}{new.year}" if american else f"{new.day:02d}{mark}{new.month:02d}{mark}{new.year}"
    return None


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def by_class(f: Feistel, text: str, kind: str, classes: tuple[str, ...] = _CLASSES) -> str:
    """Permutes letters and digits within their classes; all else stays."""
    alphabet = [next((c for c in classes if x in c), None) for x in text]
    value, size = 0, 1
    for x, c in zip(text, alphabet):
        if c:
            value, size = value * len(c) + c.index(x), size * len(c)
    value = f.permute(value, size, f"{kind}|{''.join('-' if c is None else str(classes.index(c)) for c in alphabet)}")
    out = []
    for x, c in zip(reversed(text), reversed(alphabet)):
        if c:
            value, i = divmod(value, len(c))
            x = c[i]
        out.append(x)
    return "".join(reversed(out))


def _mod97(text: str) -> int:
    return int("".join(str(int(x, 36)) for x in text)) % 97


def iban(f: Feistel, text: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = by_class(f, plain[4:], "iban")
    new = iter(plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body)
    return "".join(x if x == " " else next(new) for x in text)


def email(f: Feistel, text: str) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{by_class(f, local, 'email')}@{domain}"


def secret(f: Feistel, text: str) -> str | None:
    named = re.match(r"(?s)(.*?[=:]\s*[\"']?)(.*)", text)
    lead, value = named.groups() if named else (text[:4], text[4:])
    if len(value) < 12 and not re.search("[0-9]", value):
        return None
    hexes = re.fullmatch("[0-9a-f]+", value)
    return lead + by_class(f, value, "secret", ("0123456789", "abcdef") if hexes else _CLASSES)


#: The patterns, in the order in which they are tried at a place.
PATTERNS: list[tuple[str, str, Callable[[Feistel, str], str | None]]] = [
    ("secret", r"(?i:password|passwd|secret|token|api[_-]?key|access[_-]?key)[\w-]{0,64}\s*[=:]\s*[\"']?[A-Za-z0-9+/_-]{8,}|\bAKIA[A-Z0-9]{16}\b", secret),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b", email),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", ssn),
    ("date", r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})(?![\w/-])", date),
    ("ipv4", r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?\w)", ipv4),
    ("phone", r"(?<![\w+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<!\w)\+[0-9]{10,14}(?!\w)"
              r"|(?<!\w)\+[1-9][0-9]{0,2}(?:[ .-](?:\(0\)[ .-]?)?[0-9]{1,8}){2,6}(?!\w)|(?<![\w.,+-])0[1-9][0-9]{1,4}[ /-][0-9]{6,8}(?![\w-])", phone),
    # cards in their usual groups come before any other digits that pass the check
    ("card", r"(?<!\w)(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})(?!\w)", card),
    ("card", r"(?<!\w)[0-9](?:[ -]?[0-9]){12,18}(?!\w)", card),
]
KINDS = list(dict.fromkeys(name for name, _, _ in PATTERNS))
#: Kinds of no fixed length, whose pattern may take in a neighbour behind a space or hyphen.
GROUPED = ("card", "iban")
#: Any text with a value has one of these; most texts have not and are passed on.
_HINT = r"[0-9][0-9]|@|[0-9][ ./-][0-9]|AKIA|=|:"


def pseudonymize(text: str, feistel: Feistel, known: dict[tuple[str, str], str | None]) -> tuple[str, dict[str, int]]:
    """The text with its values replaced and counts by kind.

    A match that does not validate, or that reaches into a value found before, is tried with
    shorter ends at its group borders; then the search goes on from its next start, and
    for the other kinds within it.
    """
    counts: dict[str, int] = {}
    taken: list[tuple[int, int, str]] = []  # by place, apart from each other

    def value(kind: str, make: Callable[[Feistel, str], str | None], a: int, b: int) -> str | None:
        i = bisect_left(taken, (b,))
        if i and taken[i - 1][1] > a:
            return None
        old = text[a:b]
        if (kind, old) not in known:
            if len(known) > 100_000:
                known.clear()
            known[kind, old] = make(feistel, old)
        return known[kind, old]

    for kind, pattern, make in COMPILED:
        m = pattern.search(text)
        while m:
            a, at = m.start(), m.start() + 1
            ends = [m.end()]
            if kind in GROUPED:
                ends += [b for b in range(m.end() - 1, a, -1) if text[b] in " -" and pattern.fullmatch(text, a, b)]
            for b in ends:
                new = value(kind, make, a, b)
                if new is not None:
                    insort(taken, (a, b, new))
                    counts[kind] = counts.get(kind, 0) + 1
                    at = b
                    break
            m = pattern.search(text, at)
    out, at = [], 0
    for a, b, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), counts


COMPILED = [(name, re.compile(pattern), make) for name, pattern, make in PATTERNS]


def pseudonymize_documents(docs: DataFrame, key: str, column: str = "text", count: bool = True) -> DataFrame:
    """``docs`` with ``column`` rewritten and, if ``count``, a count ``n_<kind>`` per kind.

    ``key`` decides on the pseudonyms: equal values have equal ones in all corpora of one key."""
    if not key:
        raise ValueError("pseudonyms need a key")
    names = [f"n_{k}" for k in KINDS] if count else []
    given = docs.select(*columns(docs, without=tuple(names)))
    rest = given.columns
    at = rest.index(column)
    schema = StructType([*given.schema.fields, *(StructField(n, IntegerType()) for n in names)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel, known = Feistel(key.encode()), {}
        for batch in batches:
            texts = batch.column(at)
            counts = {k: [0] * len(texts) for k in KINDS}
            new: dict[int, str] = {}
            for row in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, _HINT), False)).to_pylist():
                old = texts[row].as_py()
                new[row], found = pseudonymize(old, feistel, known)
                for kind, n in found.items():
                    counts[kind][row] = n
            if new:
                mask = pa.array([i in new for i in range(len(texts))])
                texts = pc.replace_with_mask(texts, mask, pa.array([new[i] for i in sorted(new)], texts.type))
            found = [pa.array(counts[k], pa.int32()) for k in KINDS] if count else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :], *found], rest + names)

    # by place, as this call looks names up and reads a dot in them as a field's
    return given.toDF(*(f"c{i}" for i in range(len(rest)))).mapInArrow(scan, schema)
