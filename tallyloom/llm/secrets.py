"""Secret scans with structural confirmation.

Base kinds, whose rules are fixed: assign (a credential name, a colon or equals sign, a value), access (an access
key id), hex (a long run of hex digits). Added kinds are reported only if the candidate's structure is confirmed
by decoding it: jwt (a signed token: its header is JSON with an algorithm, its payload JSON, its signature
base64), pem (a private key block: base64 of nested length-prefixed values, or of the OpenSSH key magic; an encrypted one
too, which names its cipher in a header or in the values), der (the same as bare base64, on one line or wrapped),
der_hex (the same as hex), checked_token (a prefixed token whose last six characters are the CRC-32 of the rest),
pem_base64 (base64, on one line or wrapped, of a text that holds a key block).

Offsets are code points, end exclusive; spans are ordered by start, then kind as listed. Defined cases: a null or
empty text has no spans (a null one stays null when redacted); texts, very long ones too, are scanned whole in linear
time (a wrapped key is at most MOST_KEY bytes, a wrapped text is looked at up to MOST_ENCODED characters); spans of several kinds may overlap and start at one place; repeated rows give equal rows; an empty table gives an
empty result; other columns stay, those named like a result column, in any letter case, give way.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import SPANS, scan_texts, texts_of
from tallyloom.llm.textscan import Covered

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "der_hex", "checked_token", "pem_base64")
#: Longest wrapped key in bytes (RSA of 16,384 bits takes 9,300), and longest wrapped text with a key block in characters.
MOST_KEY, MOST_ENCODED = 12_000, 65_536

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_KEYS = (re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}"), re.compile(r"[0-9A-F]{24,}"))
_ESCAPED_END = re.compile(r"\\+[nr]")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,12}\x20){0,3}PRIVATE KEY-----((?:(?:\s|\\++[nr])*+[A-Za-z][A-Za-z-]{0,30}:[^\r\n\\]*+(?:\r?\n|\\++[nr]))*+)((?:[A-Za-z0-9+/=\s]++|\\++[nr])*+)-----END (?:[A-Z0-9]{1,12}\x20){0,3}PRIVATE KEY-----")
_CIPHER = re.compile(r"DEK-Info:\s*[A-Z0-9-]{3,30},\s*[0-9A-Fa-f]{16,}")
_RUN, _BREAK = re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"\r?\n[ \t]*")
_B64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SSH_MAGIC = b"openssh-key-v1\x00"
#: How bare base64 begins whose first byte is that of a sequence, whatever its length, or that of the OpenSSH magic.
_B64_STARTS = (*(f"M{c}" for c in "ABCDEFGHIJKLMNOP"), "b3BlbnNzaC1rZXktdjEA")
#: How base64 shows the beginning of a key block, by its place in a group of three bytes.
_B64_BLOCKS = tuple(base64.b64encode(b"\0" * i + b"-----BEGIN")[(8 * i + 5) // 6 : (8 * (i + 10)) // 6].decode() for i in range(3))


def _b64(text: str, url: bool = False) -> bytes | None:
    body = re.sub(r"\s+", "", text).rstrip("=")
    if not body or len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _values(data: bytes) -> list[tuple[int, bytes]] | None:
    """The tagged values that fill data exactly, or None if the lengths do not nest."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_private_key(data: bytes | None) -> bool:
    """A private key: one sequence that fills the data, whose lengths nest, a small version number first and key matter after it."""
    if not data or len(data) < 24:
        return False
    if data.startswith(_SSH_MAGIC):
        n = int.from_bytes(data[15:19], "big")
        return 0 < n <= 64 and 19 + n <= len(data)
    outer = _values(data) if data[0] == 0x30 else None
    if not outer or len(outer) != 1:
        return False
    inner = _values(outer[0][1])
    if not inner or len(inner) < 2 or inner[0][0] != 0x02 or inner[0][1] not in (b"\x00", b"\x01"):
        return False
    tags = [t for t, _ in inner]
    if tags[1] == 0x30:  # algorithm, then the key as an octet string
        return len(tags) >= 3 and tags[2] == 0x04 and bool(_values(inner[1][1]))
    return tags[1] == 0x04 or len(tags) >= 6 and {*tags[1:]} <= {0x02, 0x30}


def is_encrypted_key(data: bytes | None) -> bool:
    """An encrypted private key: a sequence of an algorithm with its identifier, and an octet string."""
    outer = _values(data) if data and data[0] == 0x30 else None
    inner = _values(outer[0][1]) if outer and len(outer) == 1 else None
    if not inner or [t for t, _ in inner] != [0x30, 0x04]:
        return False
    method = _values(inner[0][1])
    return bool(method) and method[0][0] == 0x06 and len(inner[1][1]) >= 16


def is_key_block(headers: str, body: str) -> bool:
    """What stands between the markers of a private key block."""
    data = _b64(_ESCAPED_END.sub("", body))
    if _CIPHER.search(headers):
        return bool(data) and len(data) >= 32 and len(data) % 8 == 0
    return is_private_key(data) or is_encrypted_key(data)


def _end_of(text: str, at: int, chars: int) -> int | None:
    """Where so many characters of base64 end that begin at a place, line ends between them; None if there are fewer."""
    while True:
        m = _RUN.match(text, at)
        if not m:
            return None
        if m.end() - at >= chars:
            return at + chars
        chars -= m.end() - at
        gap = _BREAK.match(text, m.end())
        if not gap:
            return None
        at = gap.end()


def _padded(text: str, end: int) -> int:
    """A place behind base64, moved over its padding."""
    return end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))


def wrapped_key(text: str, at: int) -> int | None:
    """The end of a private key as base64 over several lines; its own length says how far it goes."""
    head = _end_of(text, at, 12)
    data = _b64(text[at : at + 12]) if head == at + 12 else None
    if not data or data[0] != 0x30:
        return None
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    size = 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1])
    if n > 4 or size > MOST_KEY or data[2 + n : 3 + n] not in (b"\x02", b"\x30"):
        return None
    end = _end_of(text, at, (size * 8 + 5) // 6)
    if end is None or _RUN.match(text, end):
        return None
    key = _b64(text[at:end])
    return _padded(text, end) if is_private_key(key) or is_encrypted_key(key) else None


def encoded_block(text: str, at: int) -> int | None:
    """The end of base64, over lines or not, whose text holds a private key block."""
    end, stop = at, at + MOST_ENCODED
    while m := _RUN.match(text, end, stop):
        end = m.end()
        gap = _BREAK.match(text, end, stop)
        if not gap or not _RUN.match(text, gap.end(), stop):
            break
        end = gap.end()
    body = re.sub(r"\s+", "", text[at:end])
    plain = (_b64(body[: len(body) - (len(body) % 4 == 1)]) or b"").decode("latin-1")
    found = next((m for m in _PEM.finditer(plain) if is_key_block(m[1], m[2])), None)
    if not found:
        return None
    if not plain[found.end() :].strip():
        return _padded(text, end)
    return _end_of(text, at, (found.end() * 8 + 5) // 6)


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".")
    try:
        header, claims = (json.loads(_b64(x, url=True) or b"x") for x in (head, body))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def is_checked_token(text: str) -> bool:
    crc, tail = zlib.crc32(text[4:-6].encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        tail = _BASE62[d] + tail
    return tail == text[-6:]


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind."""
    out = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            out.append(("assign", *m.span()))
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    runs = [m.span() for m in _HEX.finditer(text)]
    out += [("hex", a, b) for a, b in runs]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN" in text:
        out += [("pem", *m.span()) for m in _PEM.finditer(text) if is_key_block(m[1], m[2])]
    blocks, done = Covered((a, b) for k, a, b in out if k in ("pem", "jwt")), 0
    for m in _B64.finditer(text):
        a, b = m.span()
        if a < done or blocks.meets(a, b):
            continue
        if m[0].startswith(_B64_STARTS):
            end = b if is_private_key(_b64(m[0])) else wrapped_key(text, a)
            if end:
                out.append(("der", a, end))
                done = end
        elif any(x in m[0] for x in _B64_BLOCKS) and (end := encoded_block(text, a)):
            out.append(("pem_base64", a, end))
            done = end
    for a, b in {*runs, *(m.span() for p in _HEX_KEYS for m in p.finditer(text))}:
        if text.startswith("30", a) and (b - a) % 2 == 0 and is_private_key(bytes.fromhex(text[a:b])):
            out.append(("der_hex", a, b))
    out += [("checked_token", *m.span()) for m in _TOKEN.finditer(text) if is_checked_token(m[0])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with secret_spans: array of (kind, start, end, score); confirmed and base spans score 1."""

    def columns_of(column: pa.Array) -> list[list]:
        return [[[{"kind": k, "start": a, "end": b, "score": 1.0} for k, a, b in find_spans(t)] for t in texts_of(column)]]

    return scan_texts(docs, text, [T.StructField("secret_spans", SPANS)], columns_of, keep=keep)


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of find_secrets' spans, and n_spans, the number of all of them, in built-in functions."""
    spelled = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("secret_spans", lambda x: x["kind"].isin(*BASE_KINDS))
    made = {"secret_spans", "base_sha256", "spans", "n_spans", *(f"n_{k}" for k in BASE_KINDS)}
    return found.select(
        *[F.col(f"`{c}`") for c in found.columns if c.lower() not in made],
        *[_count("secret_spans", k).alias(f"n_{k}") for k in BASE_KINDS],
        F.size("secret_spans").cast("long").alias("n_spans"),
        F.sha2(F.array_join(F.transform(base, spelled), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secret_spans", spelled), ",").alias("spans"),
    )


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with every secret replaced by <SECRET>; overlapping spans are replaced as one, a null text stays null."""

    def clean(t: str) -> str:
        pieces, done, end = [], 0, -1
        for _, a, b in find_spans(t):
            if a >= end:
                pieces += [t[done:a], "<SECRET>"]
            done = end = max(end, b)
        return "".join([*pieces, t[done:]])

    def columns_of(column: pa.Array) -> list[list]:
        return [[None if t is None else clean(t) for t in column.to_pylist()]]

    return scan_texts(docs, text, [T.StructField(text, T.StringType())], columns_of).select(*[F.col(f"`{c}`") for c in docs.columns])

