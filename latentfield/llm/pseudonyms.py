"""Personal data under format-preserving Feistel pseudonyms.

Numbers and dates are validated first (checksums, ranges, calendar). What is left free by their format
is a whole number below some bound; a keyed Feistel network permutes the numbers below that bound,
so a value becomes another valid value of its format, equal values become equal ones in every
document, and whoever has the key can turn them back. Of mail addresses the name before the @ is
permuted, letters as letters and digits as digits, whatever their case; the domain and the case of each place stay.

A pseudonym could read as a value of another kind (a phone whose digits pass for a card). So each value's
permutation is walked on until a result is found again, as the same kind and whole, if the value itself is; and a
stretch of text in which pseudonyms still form other values together with their neighbours is walked on as one.
Both ways walk alike, so texts turn back. A stretch that finds no such state in WALK steps (it takes very many values
side by side) keeps its first pseudonyms and may not turn back.

Defined cases: null text has no finds and no row in found_documents(); pseudonymised() leaves null,
empty and clean texts as they are; a null doc_id is passed through; repeated rows and equal values
get equal pseudonyms; texts of any length are searched whole; other columns pass through unread.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, small

ROUNDS = 8
WALK = 256
KINDS = ("email", "iban", "card", "ssn", "phone", "ipv4", "date")
#: English month names, which dates in words use.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CARD = re.compile(r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\w-])")
SSN = re.compile(r"(?<![\w.-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![\w-])")
PHONE = re.compile(r"(?<![\w.])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w.])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\w-])")
IPV4 = re.compile(r"(?<![\w.])([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(?![\w]|\.[0-9])")
ISO_DATE = re.compile(r"(?<![\w.-])([0-9]{4})-([0-9]{2})-([0-9]{2})(?=T[0-9]|(?![\w-]))")
SLASH_DATE = re.compile(r"(?<![\w./-])([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?![\w/-])")
WORD_DATE = re.compile(rf"(?<![\w.-])(?:([0-9]{{1,2}}) ({'|'.join(MONTHS)}) ([0-9]{{4}})|({'|'.join(MONTHS)}) ([0-9]{{1,2}}), ([0-9]{{4}}))(?![\w-])")
#: No value, and nothing that decides whether one stands somewhere, reaches beyond such a stretch.
STRETCH = re.compile(r"[\w ._%+@()/,-]+")
#: Days that dates are permuted among.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of the numbers below any bound, by walking along a slightly larger square's cycle."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def part(self, tweak: bytes, n: int, k: int, x: int) -> int:
        data = b"%d|%d|%d|" % (n, k, x) + tweak
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def permuted(self, x: int, n: int, tweak: bytes, back: bool = False) -> int:
        if n < 2:
            return x
        side = math.isqrt(n - 1) + 1
        while True:
            left, right = divmod(x, side)
            if back:
                for k in reversed(range(ROUNDS)):
                    left, right = (right - self.part(tweak, n, k, left)) % side, left
            else:
                for k in range(ROUNDS):
                    left, right = right, (left + self.part(tweak, n, k, right)) % side
            x = left * side + right
            if x < n:
                return x

    def mixed_radix(self, values: list[int], radices: list[int], tweak: bytes, back: bool = False) -> list[int]:
        """The same for a number whose digits have different bases."""
        x = 0
        for v, r in zip(values, radices):
            x = x * r + v
        x = self.permuted(x, math.prod(radices), tweak, back)
        out = []
        for r in reversed(radices):
            x, v = divmod(x, r)
            out.append(v)
        return out[::-1]


def luhn(digits: list[int]) -> int:
    """The check sum modulo 10; 0 for a valid number."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10


def refilled(shape: str, digits: list[int]) -> str:
    """shape with its digits replaced, in order."""
    it = iter(digits)
    return "".join(str(next(it)) if c.isdigit() else c for c in shape)


def digits_of(s: str) -> list[int]:
    return [int(c) for c in s if c.isdigit()]


def card(f: Feistel, s: str, back: bool) -> str | None:
    d = digits_of(s)
    if luhn(d) or not any(d) or d[0] == 0:
        return None
    body = f.mixed_radix(d[1:-1], [10] * (len(d) - 2), b"card", back)
    new = [d[0], *body, 0]
    new[-1] = -luhn(new) % 10
    return refilled(s, new)


def ssn(f: Feistel, s: str, back: bool) -> str | None:
    area, group, serial = (int(x) for x in s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    a, g, n = f.mixed_radix([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], b"ssn", back)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{n + 1:04d}"


def phone(f: Feistel, s: str, back: bool) -> str | None:
    d = digits_of(s)
    head = 1 if s.startswith("+1") and len(d) == 11 else 0
    if len(d) - head == 10 and (head or not s.startswith("+")):
        if d[head] < 2 or d[head + 3] < 2:
            if not head:
                return None
            # with +1 it is a phone all the same: permuted among those that break the rule, so that it can be turned back
            body = d[head:]
            while True:
                body = f.mixed_radix(body, [10] * 10, b"phone+1", back)
                if body[0] < 2 or body[3] < 2:
                    return refilled(s, d[:head] + body)
        radices = [8 if i in (0, 3) else 10 for i in range(10)]
        got = f.mixed_radix([v - 2 * (i in (0, 3)) for i, v in enumerate(d[head:])], radices, b"phone", back)
        return refilled(s, d[:head] + [v + 2 * (i in (0, 3)) for i, v in enumerate(got)])
    if not s.startswith("+") or not 8 <= len(d) <= 15:
        return None
    keep = len(re.match(r"\+(\d{1,3})", s)[1])
    if len(d) - keep < 6:
        return None
    return refilled(s, d[:keep] + f.mixed_radix(d[keep:], [10] * (len(d) - keep), b"phone+", back))


def ipv4(f: Feistel, s: str, back: bool) -> str | None:
    parts = s.split(".")
    v = [int(x) for x in parts]
    if any(x > 255 for x in v) or any(len(p) > 1 and p[0] == "0" for p in parts) or not 1 <= v[0] <= 223 or v[0] == 127:
        return None
    first = v[0] - 1 - (v[0] > 127)
    a, b, c, d = f.mixed_radix([first, *v[1:]], [222, 256, 256, 256], b"ipv4", back)
    return f"{a + 1 + (a >= 126)}.{b}.{c}.{d}"


def other_day(f: Feistel, day: int, back: bool, like: Callable[[datetime.date], bool]) -> datetime.date | None:
    """The next day in the permutation that is like the given one, as an ordinal; None outside the days that are permuted."""
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    while True:
        day = FIRST_DAY + f.permuted(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, b"date", back)
        if like(datetime.date.fromordinal(day)):
            return datetime.date.fromordinal(day)


def ordinal(year: int, month: int, day: int) -> int:
    """0 for a day that the calendar doesn't have."""
    try:
        return datetime.date(year, month, day).toordinal()
    except ValueError:
        return 0


def iso_date(f: Feistel, s: str, back: bool) -> str | None:
    new = other_day(f, ordinal(*(int(x) for x in s.split("-"))), back, lambda d: True)
    return new and new.isoformat()


def slash_date(f: Feistel, s: str, back: bool) -> str | None:
    """Month first where that is a day of the calendar, else day first; with or without leading zeros, as it was."""
    a, b, year = s.split("/")
    month_first = ordinal(int(year), int(a), int(b)) > 0
    full = len(a) == len(b) == 2

    def shown(d: datetime.date) -> tuple[int, int]:
        return (d.month, d.day) if month_first else (d.day, d.month)

    if not full and "0" in (a[0], b[0]):
        return None

    def like(d: datetime.date) -> bool:
        return (month_first or d.day > 12) and (full or min(shown(d)) < 10)

    new = other_day(f, ordinal(int(year), int(a), int(b)) or ordinal(int(year), int(b), int(a)), back, like)
    return new and ("{:02d}/{:02d}/{:04d}" if full else "{}/{}/{:04d}").format(*shown(new), new.year)


def word_date(f: Feistel, s: str, back: bool) -> str | None:
    m = WORD_DATE.fullmatch(s)
    day, month, year = (m[1], m[2], m[3]) if m[1] else (m[5], m[4], m[6])
    zero = day[0] == "0"
    new = other_day(f, ordinal(int(year), MONTHS.index(month) + 1, int(day)), back, lambda d: not zero or d.day < 10)
    shown = new and (f"{new.day:02d}" if zero else str(new.day))
    return new and (f"{shown} {MONTHS[new.month - 1]} {new.year}" if m[1] else f"{MONTHS[new.month - 1]} {shown}, {new.year}")


def iban_check(country: str, body: str) -> int:
    """What the two check digits must be."""
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def by_characters(f: Feistel, s: str, tweak: bytes, back: bool) -> str:
    """Letters and digits permuted together, each within its own kind."""
    sets = [next((x for x in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in x), c) for c in s]
    got = f.mixed_radix([x.index(c) for x, c in zip(sets, s)], [len(x) for x in sets], tweak + b"|" + re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s))).encode(), back)
    return "".join(x[v] for x, v in zip(sets, got))


def iban(f: Feistel, s: str, back: bool) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or int(flat[2:4]) != iban_check(flat[:2], flat[4:]):
        return None
    body = by_characters(f, flat[4:], b"iban" + flat[:2].encode(), back)
    new = iter(f"{flat[:2]}{iban_check(flat[:2], body):02d}{body}")
    return "".join(c if c == " " else next(new) for c in s)


def email(f: Feistel, s: str, back: bool) -> str | None:
    name, _, domain = s.rpartition("@")
    new = by_characters(f, name.lower(), b"email", back)
    return "".join(c.upper() if x.isupper() else c for x, c in zip(name, new)) + "@" + domain


#: Earlier kinds win where spans overlap.
RULES: tuple[tuple[str, re.Pattern[str], Callable[[Feistel, str, bool], str | None]], ...] = (
    ("email", EMAIL, email),
    ("iban", IBAN, iban),
    ("card", CARD, card),
    ("ssn", SSN, ssn),
    ("phone", PHONE, phone),
    ("ipv4", IPV4, ipv4),
    ("date", ISO_DATE, iso_date),
    ("date", SLASH_DATE, slash_date),
    ("date", WORD_DATE, word_date),
)
DIGIT = re.compile("[0-9]")
Span = tuple[int, int, int]


def located(f: Feistel, text: str) -> list[Span]:
    """Start, end and rule of each validated value, by place, without overlap."""
    out: list[Span] = []
    some = DIGIT.search(text) is not None
    for k, (kind, pattern, rule) in enumerate(RULES):
        if kind == "email" and "@" not in text or kind != "email" and not some:
            continue
        new: list[Span] = []
        for m in pattern.finditer(text):
            s, e = m.span()
            at = bisect.bisect_right(out, (s, len(text) + 1, 0))
            if at and out[at - 1][1] > s or at < len(out) and out[at][0] < e:
                continue
            if rule(f, m[0], False) is not None:
                new.append((s, e, k))
        out = sorted(out + new) if new else out
    return out


def walked(f: Feistel, value: str, k: int, back: bool) -> str:
    """The next value of the permutation that is found by itself as this one is, or isn't as this one isn't."""
    found = located(f, value) == [(0, len(value), k)]
    while True:
        value = RULES[k][2](f, value, back)
        if (located(f, value) == [(0, len(value), k)]) == found:
            return value


def moved(spans: list[Span], values: list[str]) -> list[Span]:
    """Where spans stand once they hold these values."""
    out, shift = [], 0
    for (s, e, k), x in zip(spans, values):
        out.append((s + shift, s + shift + len(x), k))
        shift += len(x) - (e - s)
    return out


def stretched(f: Feistel, text: str, spans: list[Span], back: bool) -> list[str]:
    """New values for the spans of one stretch of text: the first after which the same rules find them all again."""
    first: list[str] = []
    now, at = text, spans
    for _ in range(WALK):
        values = [walked(f, now[s:e], k, back) for s, e, k in at]
        now, at = replaced(now, [(s, e, "", x) for (s, e, _), x in zip(at, values)]), moved(at, values)
        first = first or values
        if located(f, now) == at:
            return values
    return first


def finds(f: Feistel, text: str, back: bool = False) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and pseudonym (or, with back, the value before) of each validated value, by place, without overlap."""
    spans = located(f, text)
    if not spans:
        return []
    values = [walked(f, text[s:e], k, back) for s, e, k in spans]
    found = [(s, e, RULES[k][0], x) for (s, e, k), x in zip(spans, values)]
    if located(f, replaced(text, found)) == moved(spans, values):
        return found
    found, at = [], 0
    for m in STRETCH.finditer(text):
        here = []
        while at < len(spans) and spans[at][0] < m.end():
            s, e, k = spans[at]
            here.append((s - m.start(), e - m.start(), k))
            at += 1
        if here:
            found += [(s + m.start(), e + m.start(), RULES[k][0], x) for (s, e, k), x in zip(here, stretched(f, m[0], here, back))]
    return found


def replaced(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for s, e, _, new in found:
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:]


def pseudonymised(docs: DataFrame, key: bytes, *, back: bool = False) -> DataFrame:
    """docs with the personal data in text replaced (or, with back, restored); all other columns stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for b in small(batches, at):
            cols = list(b.columns)
            cols[at] = pa.array([replaced(x, finds(f, x, back)) if x else x for x in cols[at].to_pylist()], b.schema.types[at])
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return in_parts(docs).mapInArrow(run, docs.schema)


def found_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """One row for each document that holds personal data: doc_id, n_found, spans (kind:start:end by place), pseudonyms (by place) and text_sha256 of the pseudonymised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for b in small(batches, "text"):
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if text and (found := finds(f, text)):
                    rows.append((i, len(found), ",".join(f"{k}:{s}:{e}" for s, e, k, _ in found), "|".join(x for *_, x in found), hashlib.sha256(replaced(text, found).encode()).hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["doc_id", "n_found", "spans", "pseudonyms", "text_sha256"])

    return in_parts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_found long, spans string, pseudonyms string, text_sha256 string")
