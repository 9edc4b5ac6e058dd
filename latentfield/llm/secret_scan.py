"""Secret scans with structural confirmation.

Three base patterns find credentials by their form alone. Candidates for encoded keys and tokens are
decoded first and reported only if what they hold parses: DER sequences of private keys whose nested lengths fill
the bytes, OpenSSH key blobs with their nested counted strings, PEM blocks around either (their line ends may be
escaped, and encrypted ones have headers in place of a structure), base64 of either over several lines, and
signed tokens whose header is JSON that names an algorithm. Public keys are no secrets and aren't reported.

Defined cases: null text is empty and has no spans; a null doc_id is passed through; repeated rows
give the same result each; texts of any length are searched whole; other columns are never read.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, small

#: Fixed by the contract of the scan: kinds in their order, with patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so a least length in the pattern drops the same matches
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

JWT = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}")
#: Where a PEM block begins. What stands inside is found and parsed step by step, in one pass.
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
#: Headers of a PEM block, up to the line's end, which may be escaped; and what an encrypted one must say.
PEM_HEADER = re.compile(r"(?:\s|\\[nr])*+([A-Z][A-Za-z-]{2,30}): ?([A-Za-z0-9,-]{1,80})(?=\s|\\[nr])")
ENCRYPTION = re.compile(r"[A-Z0-9-]+,(?:[0-9A-Fa-f]{2}){8,16}")
BLANK = dict.fromkeys(map(ord, " \t\n\r\x0b\x0c"))
#: Base64 of a DER sequence begins with M, of an OpenSSH blob with b3BlbnNza; hex of a DER sequence with 30.
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Za-z0-9+/_-]{39,}|b3BlbnNza[A-Za-z0-9+/_-]{31,})={0,2}")
#: The first line of the same over lines, with real or escaped ends; a further line; and all further lines.
FIRST_LINE = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M|b3BlbnNza)[A-Za-z0-9+/]{39,75}(?=\r?\n|\\r\\n|\\n)")
NEXT_LINE = re.compile(r"(?:\r?\n|\\r\\n|\\n)[ \t]*+([A-Za-z0-9+/]{1,76})")
OTHER_LINES = re.compile(r"(?:(?:\r?\n|\\r\\n|\\n)[ \t]*+[A-Za-z0-9+/]{1,76}+)*+")
#: No key has so many fields in one sequence; what has more is not listed.
MOST_FIELDS = 1000
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}(?![0-9A-Fa-f])")
SSH_MAGIC = b"openssh-key-v1\x00"

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def decoded(text: str) -> bytes | None:
    """Bytes of base64 of either alphabet, white space ignored; None if it is malformed."""
    s = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Length of the value and where it begins; None unless it is the shortest form."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    k = first & 0x7F
    if not 1 <= k <= 4 or at + 1 + k > len(data):
        return None
    n = int.from_bytes(data[at + 1 : at + 1 + k], "big")
    return None if n < 0x80 or n >> (8 * (k - 1)) == 0 else (n, at + 1 + k)


def der_fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the values that fill data[start:end] without a gap; None if they don't, or are more than a key's."""
    out, at = [], start
    while at < end:
        if len(out) == MOST_FIELDS:
            return None
        found = der_length(data, at + 1)
        if found is None or found[1] + found[0] > end:
            return None
        out.append((data[at], found[1], found[1] + found[0]))
        at = found[1] + found[0]
    return out


def is_der_key(data: bytes) -> bool:
    """A private key, encrypted or not: one sequence that fills the bytes and whose fields, nested ones too, fill theirs."""
    top = der_fields(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    fields = der_fields(data, *top[0][1:])
    if not fields or len(fields) < 2:
        return False
    tags = [t for t, _, _ in fields]
    nested = [der_fields(data, s, e) for t, s, e in fields if t == 0x30]
    if any(x is None for x in nested):
        return False
    if tags[:1] == [0x02]:
        version = data[fields[0][1] : fields[0][2]]
        rsa = len(tags) >= 9 and all(t == 0x02 for t in tags[:9])
        pkcs8 = len(tags) >= 3 and tags[1:3] == [0x30, 0x04] and nested[0] and nested[0][0][0] == 0x06
        ec = len(tags) >= 2 and tags[1] == 0x04 and version == b"\x01"
        return bool(rsa or pkcs8 or ec)
    return bool(tags == [0x30, 0x04] and nested[0] and nested[0][0][0] == 0x06)


def ssh_size(data: bytes) -> tuple[int, bool] | None:
    """How many bytes an OpenSSH key has that begins like this, and True; or how many are needed to tell more, and False. None if it is none."""
    if not data.startswith(SSH_MAGIC[: len(data)]):
        return None
    at, strings = len(SSH_MAGIC), 3
    while strings:
        if len(data) < at + 4:
            return at + 4, False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        strings -= 1
    if len(data) < at + 4:
        return at + 4, False
    count = int.from_bytes(data[at : at + 4], "big")
    if not 1 <= count <= 16:
        return None
    at += 4
    for _ in range(count + 1):
        if len(data) < at + 4:
            return at + 4, False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at, True


def is_ssh_key(data: bytes) -> bool:
    """openssh-key-v1: cipher, derivation, its options, a count, then a counted public key that names its type."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    strings = []
    for _ in range(3):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        strings.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    count = int.from_bytes(data[at : at + 4], "big")
    n = int.from_bytes(data[at + 4 : at + 8], "big")
    inner = data[at + 8 : at + 8 + n]
    k = int.from_bytes(inner[:4], "big")
    return 1 <= count <= 16 and len(inner) == n and 4 < 4 + k <= n and inner[4 : 4 + k].startswith((b"ssh-", b"ecdsa-", b"sk-")) and bool(strings[0])


def is_signed_token(text: str) -> bool:
    header, payload, signature = text.split(".")[:3]
    raw, body, sign = decoded(header), decoded(payload), decoded(signature)
    if raw is None or body is None or not sign:
        return False
    try:
        head = json.loads(raw)
        json.loads(body)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans, each kind leftmost and without overlap."""
    out = []
    if "=" in text or ":" in text:
        lower = text.lower()
        if any(w in lower for w in WORDS):
            out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or is_ssh_key(data))


def joined_lines(text: str) -> str:
    """Without white space and escaped line ends."""
    return text.replace("\\n", "").replace("\\r", "").translate(BLANK)


def is_pem_key(body: str) -> bool:
    """What stands between the lines of a PEM block: base64 of a key, or headers of an encrypted key and whole base64."""
    at, headers = 0, []
    if ":" in body:
        while m := PEM_HEADER.match(body, at):
            headers.append((m[1], m[2]))
            at = m.end()
    flat = joined_lines(body[at:])
    if ":" in flat or "-" in flat or "_" in flat:
        return False
    data = decoded(flat)
    locked = any(a == ("Proc-Type", "4,ENCRYPTED") and b[0] == "DEK-Info" and ENCRYPTION.fullmatch(b[1]) for a, b in zip(headers, headers[1:]))
    return is_key(data) or bool(data) and locked


def pem_keys(text: str) -> list[tuple[int, int]]:
    """Blocks of private keys. A block ends at the next five dashes, which must be its own end; each character is looked at once."""
    out, at = [], 0
    while m := BEGIN.search(text, at):
        at = text.find("-----", m.end())
        if at < 0:
            break
        last = f"-----END {m[1]}-----"
        if text.startswith(last, at):
            if is_pem_key(text[m.end() : at]):
                out.append((m.start(), at + len(last)))
            at += len(last)
    return out


def wrapped_key(text: str, first: re.Match) -> int | None:
    """Where a key ends that begins with this line of base64. Its first bytes tell its size, so no more lines are taken than it has."""
    start, at, have = first.start(), first.end(), first.end() - first.start()

    def flat() -> str:
        return joined_lines(text[start:at])

    def whole(size: int) -> bool:
        nonlocal at, have
        n = -(-size * 4 // 3)
        if n > len(text) - start:
            return False
        while have < n:
            line = NEXT_LINE.match(text, at)
            if not line:
                return False
            at, have = line.end(), have + len(line[1])
        return True

    if text[start] == "M":
        head = base64.b64decode(text[start : start + 8])
        found = der_length(head, 1)
        if head[0] != 0x30 or not found or not whole(sum(found)):
            return None
        n = -(-sum(found) * 4 // 3)
    else:
        size, more = len(SSH_MAGIC), True
        while more and whole(size):
            told = ssh_size(base64.b64decode(flat()[: have - have % 4]))
            if told is None:
                return None
            size, more = (told[0], False) if told[1] else (told[0] + 3, True)  # three more, since only whole fours are decoded
        n = -(-size * 4 // 3) if whole(size) else have - (have % 4 == 1)  # what is cut short is judged by what is there
    if not is_key(decoded(flat()[:n])):
        return None
    end = at - (have - n)
    return end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))


def wrapped_keys(text: str) -> list[tuple[int, int]]:
    """Keys in base64 over several lines. Lines behind a key don't hide it; lines that follow a line which begins no key are passed over with it."""
    out, at = [], 0
    while m := FIRST_LINE.search(text, at):
        end = wrapped_key(text, m)
        if end is None:
            at = OTHER_LINES.match(text, m.end()).end()
        else:
            out.append((m.start(), end))
            at = end
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded structure proves a key or a signed token."""
    out = []
    if "ey" in text and "." in text:
        out += [("jwt", *m.span()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    taken = []
    if "PRIVATE KEY-----" in text:
        taken = pem_keys(text)
        out += [("pem", s, e) for s, e in taken]

    def free(s: int) -> bool:
        at = bisect.bisect_right(taken, (s, len(text) + 1))
        return not at or taken[at - 1][1] <= s

    if "\n" in text or "\\n" in text:
        more = [x for x in wrapped_keys(text) if free(x[0])]
        out += [("key", s, e) for s, e in more]
        taken = sorted(taken + more)
    out += [("key", *m.span()) for m in ENCODED.finditer(text) if free(m.start()) and is_key(decoded(m[0]))]
    for m in HEX_DER.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            out.append(("key", *m.span()))
    return out


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered(spans))


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    return base_spans(text), confirmed_spans(text)


def redacted(text: str) -> str:
    """The text with each span, overlapping ones together, replaced by [SECRET:kind]; a text without spans comes back as it is."""
    base, more = scan(text)
    out, at = [], 0
    for kind, s, e in ordered(base + more):
        if s >= at:
            out += [text[at:s], f"[SECRET:{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if at else text


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row for each document with counts, the digest of the base spans and all spans; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, "text"):
            rows = []
            for text in b.column("text").to_pylist():
                base, more = scan(text or "")
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return in_parts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text, and n_chars (if there) set anew for changed texts; rows and other columns stay."""
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, at):
            texts = b.column(at).to_pylist()
            new = [redacted(x) if x else x for x in texts]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.types[at])
            if size >= 0:
                old = b.column(size).to_pylist()
                cols[size] = pa.array([n if x == y else len(y) for n, x, y in zip(old, texts, new)], b.schema.types[size])
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return in_parts(docs).mapInArrow(run, docs.schema)
