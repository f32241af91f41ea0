"""Personal data: regular expressions propose spans, validators confirm them, nearby words adjust the score.

Kinds, in order: email, ip, card, phone (the base kinds, whose rules are fixed) and iban, ssn, local_phone.
A proposal of an added kind is kept if its validator passes and its score (a prior, plus what context words
within `reach` characters add or take away) comes to the threshold; one that overlaps a base span, or an added
span of an earlier kind, is dropped. Context words move the score of base spans too, but these always stay. Offsets
are code points, end exclusive.

Defined cases: a null or empty text has no spans (a null one stays null when redacted); texts, very long ones too,
are scanned whole, and every pattern below runs in time linear in the text, long runs of one character included; of
two spans of one kind the leftmost wins, of added spans that overlap the one of the earlier kind; repeated rows give
equal rows; an empty table gives an empty result; other columns stay, those named like a result column, in any letter
case, give way.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import SPANS, scan_texts, texts_of
from tallyloom.llm.textscan import Covered

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone")
THRESHOLD = 0.5
REACH = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always begins at the start of a run of digits, so the look-behind changes no result; it only keeps
# the search linear in a long run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(\(?)([2-9][0-9]{2})(\)?)[\x20.-]([2-9][0-9]{2})[\x20.-][0-9]{4}(?![0-9])")
#: Length of a country's account numbers.
_IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
        31: "MT SC", 32: "LC",
    }.items()
    for country in countries.split()
}
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Words near a proposal that make it likelier, and words that make it less likely.
CONTEXT = {
    "email": (("mail", "email", "contact", "write", "reply"), ("example", "sample", "noreply")),
    "ip": (("ip", "address", "host", "server", "client", "login"), ("version", "release", "section", "chapter")),
    "card": (("card", "visa", "mastercard", "credit", "debit", "payment", "karte", "tarjeta", "carte"), ("isbn", "order", "tracking", "serial")),
    "phone": (("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "handy"), ("isbn", "order", "invoice", "id")),
    "iban": (("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"), ("isbn", "part", "serial")),
    "ssn": (("ssn", "social", "security", "taxpayer"), ("part", "order", "invoice", "serial")),
    "local_phone": (("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "handy"), ("isbn", "order", "invoice", "id")),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.6, "ssn": 0.3, "local_phone": 0.25}
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an account number: its first four characters go last, letters count from ten."""
    s = iban[4:] + iban[:4]
    rest = 0
    for c in s:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain. Each holds one @, so the @s are walked and the local part grown to the left."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, m.end() if m else 0))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base kinds, each kind on its own."""
    found: dict[str, list[tuple[int, int]]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found["phone"].append(m.span())
    return found


def _iban_end(m: re.Match) -> int | None:
    """Where the account number that starts a match ends: the pattern may have taken words after it along.

    Of the match's end and the spaces in it, the one that makes the country's length comes first, then the match's
    end; for a country of unknown length, all of them, longest first.
    """
    whole, own = m[0], _IBAN_LENGTHS.get(m[0][:2])
    ends = [len(whole), *(i for i in range(len(whole) - 1, 0, -1) if whole[i] == " ")]
    if own:
        ends = [e for e in ends if e - whole.count(" ", 0, e) == own] + ends[:1]
    for end in ends:
        if 15 <= len(s := whole[:end].replace(" ", "")) <= 34 and mod97(s):
            return m.start() + end
    return None


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers from left to right. The search goes on at the end of one found, or within a match that holds none at its start."""
    m = _IBAN.search(text)
    while m:
        end = _iban_end(m)
        if end:
            yield m.start(), end
        m = _IBAN.search(text, end or m.start() + 1)


def _valid_ssn(m: re.Match) -> bool:
    return m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"


def _valid_local(m: re.Match) -> bool:
    """Brackets in pairs; neither area nor exchange is a service code (x11), and an area's middle digit is no 9."""
    return bool(m[1]) == bool(m[3]) and m[2][1:] != "11" and m[4][1:] != "11" and m[2][1] != "9"


ADDED: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "iban": ibans,
    "ssn": lambda text: (m.span() for m in _SSN.finditer(text) if _valid_ssn(m)),
    "local_phone": lambda text: (m.span() for m in _LOCAL_PHONE.finditer(text) if _valid_local(m)),
}


def context_score(kind: str, text: str, start: int, end: int, reach: int = REACH) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - reach) : start] + " " + text[end : end + reach])}
    up, down = CONTEXT[kind]
    return max(0.0, min(1.0, PRIOR[kind] + 0.4 * bool(near & {*up}) - 0.3 * bool(near & {*down})))


def find_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """All spans by kind, then start: (kind, start, end, score). Base spans are there whatever their score."""
    base = base_spans(text)
    out = [(k, a, b, context_score(k, text, a, b)) for k in BASE_KINDS for a, b in base[k]]
    for kind, proposals in ADDED.items():
        taken = Covered((a, b) for _, a, b, _ in out)
        out += [(kind, a, b, score) for a, b in proposals(text) if not taken.meets(a, b) and (score := context_score(kind, text, a, b)) >= threshold]
    return out


def find_pii(docs: DataFrame, *, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """docs with pii_spans: array of (kind, start, end, score), by kind, then start."""

    def columns_of(column: pa.Array) -> list[list]:
        return [[[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find_spans(t, threshold)] for t in texts_of(column)]]

    return scan_texts(docs, text, [T.StructField("pii_spans", SPANS)], columns_of, keep=keep)


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of find_pii's spans, and n_spans, the number of all of them, in built-in functions."""
    spelled = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE_KINDS))
    made = {"pii_spans", "base_sha256", "spans", "n_spans", *(f"n_{k}" for k in BASE_KINDS)}
    return found.select(
        *[F.col(f"`{c}`") for c in found.columns if c.lower() not in made],
        *[_count("pii_spans", k).alias(f"n_{k}") for k in BASE_KINDS],
        F.size("pii_spans").cast("long").alias("n_spans"),
        F.sha2(F.array_join(F.transform(base, spelled), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii_spans", spelled), ",").alias("spans"),
    )


def redact_text(text: str, threshold: float = THRESHOLD) -> str:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, the first that starts stands."""
    spans = sorted((a, -b, k) for k, a, b, _ in find_spans(text, threshold))
    pieces, done = [], 0
    for a, b, kind in spans:
        b = -b
        if a >= done:
            pieces += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*pieces, text[done:]])


def redact(docs: DataFrame, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with personal data replaced; a null text stays null, other columns keep their place."""

    def columns_of(column: pa.Array) -> list[list]:
        return [[None if t is None else redact_text(t, threshold) for t in column.to_pylist()]]

    return scan_texts(docs, text, [T.StructField(text, T.StringType())], columns_of).select(*[F.col(f"`{c}`") for c in docs.columns])

