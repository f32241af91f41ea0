"""Decontamination, personal data, secrets, the tokenizer, sharding and word scanning."""

import base64
import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, same
from pyspark.sql import functions as F

from tallyloom.llm import common, decontaminate, pii, secrets, sentencepieces, sharding, textscan
from tallyloom.llm.oracles import oracle_sql
from tallyloom.llm.queries import piece_model, queries


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# scratch tables


def test_scratch_tables(spark, monkeypatch):
    from pathlib import Path

    kept = common.materialize(spark.range(10).repartition(2))
    assert sorted(r.id for r in kept.collect()) == list(range(10))
    folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert not (folder / "_SUCCESS").exists()
    assert common.clear_scratch(spark) > 0 and not folder.exists() and common.clear_scratch(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = {}
        sparkContext = type("C", (), {"applicationId": "app-of-this-test", "master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.scratch_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert common.scratch_dir(Session).startswith("file://")


# word scanning


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té漢", max_size=30), max_size=6))
def test_scan_finds_words_and_equal_hashes(texts):
    seen = {}
    for begin, end, data, offsets in textscan.chunks(pa.array(texts, pa.string()), 16):
        words = textscan.scan(data, offsets, textscan.separator_table(textscan.WHITE))
        hashes = words.hashes()
        for d in range(end - begin):
            a, n = words.first[d], words.per_doc[d]
            spelled = [data[words.starts[i] : words.ends[i]].tobytes().decode() for i in range(a, a + n)]
            assert spelled == texts[begin + d].split()
            for w, h in zip(spelled, hashes[a : a + n].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    same(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name])


# decontamination


def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = word.findall((text or "").translate(low))
    hit, found = set(), set()
    for key, item in items:
        w = word.findall((item or "").translate(low))
        for i in range(max(1, len(w) - 9) if w else 0):
            g = w[i : i + 10]
            for j in range(len(words) - len(g) + 1):
                if words[j : j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    found.add(str(key))
    return len(words), len(hit), len(found), sha(",".join(sorted(found)))


ITEMS = [(10, "Two three-four FIVE six seven eight nine ten eleven twelve"), (9, "x"), (11, None), (12, "..."), (9, "x"), (None, "naïve äöü")]


@pytest.mark.parametrize("slice_words", [1_000_000, 3, 12])
def test_decontamination_of_odd_rows(spark, odd, nothing, slice_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = odd.where("doc_id <> 4 or doc_id is null").withColumn("n_words", F.lit("clash")).withColumn("Hit_Spans", F.lit(1))
    got = decontaminate.report(decontaminate.find_contamination(rows, items, slice_words=slice_words)).collect()
    assert len(got) == rows.count()
    for r in got:
        n, hit, _, _ = brute_hits(r.text, ITEMS)
        named = brute_hits(r.text, [i for i in ITEMS if i[0] is not None])
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, named[2], named[3], hit > 0)
    assert decontaminate.find_contamination(nothing, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_documents(odd, none).count() == odd.count()


def test_slices_are_held_one_at_a_time(spark, odd, monkeypatch):
    """A benchmark of many slices, an item longer than a slice among them, gives what one slice gives, and each is written before the next is read."""
    r = random.Random(4)
    letters = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(letters) for _ in range(r.randrange(1, 40)))) for i in range(60)] + [(99, " ".join(r.choice(letters) for _ in range(900)))]
    docs = []
    for i in range(40):
        parts = [" ".join(f"x{r.randrange(50)}" for _ in range(r.randrange(20))) for _ in range(3)]
        cut = r.choice(items)[1].split()
        a = r.randrange(len(cut))
        docs.append((i, f"{parts[0]} {' '.join(cut[a : a + r.randrange(5, 60)])} {parts[1]} {r.choice(items)[1]} {parts[2]}"))
    benchmark, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    events = []
    read, written = decontaminate._pass, decontaminate.materialize
    monkeypatch.setattr(decontaminate, "_pass", lambda *a, **k: events.append("read") or read(*a, **k))
    monkeypatch.setattr(decontaminate, "materialize", lambda df: events.append("written") or written(df))
    got = decontaminate.report(decontaminate.find_contamination(table, benchmark, slice_words=200)).collect()
    assert events[0] == "written" and events[1:] == ["read", "written"] * (len(events) // 2) and len(events) > 9
    for x in got:
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256) == brute_hits(x.text, items)
    assert len(got) == len(docs)
    one = decontaminate.report(decontaminate.find_contamination(table, benchmark)).collect()
    assert sorted(map(str, one)) == sorted(map(str, got))


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that takes few values, hits are still those of the words."""
    plain = decontaminate.rolled
    monkeypatch.setattr(decontaminate, "rolled", lambda h, w: plain(h, w) % np.uint64(7))
    items = [(str(i), f"a b c d e f g h i {x} k") for i, x in enumerate("jxyzj")]
    grams = decontaminate.Grams(items, 10)
    for text in ("a b c d e f g h i j", "q b c d e f g h i z k", "a b c d e f g h j i", "A-b c d e f g h i x k a b c d e f g h i j"):
        chunk = next(decontaminate.scan_words(pa.array([text])))
        covered, found = grams.hits(chunk)
        ids = sorted({grams.ids[i] for i in found.get(0, ())})
        assert (len(covered), int(covered.sum()), len(ids), sha(",".join(ids))) == brute_hits(text, items)


def test_columns_stay_as_they_were(spark, odd):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    docs = odd.withColumn("n_words", F.lit(777)).withColumn("Item_Ids", F.lit("mine")).withColumn("HIT_SPANS", F.lit(1.5)).withColumn("a.b", F.lit(3))
    for slice_words in (1_000_000, 4):
        left = decontaminate.remove_documents(docs, items, slice_words=slice_words)
        assert left.columns == docs.columns
        want = [r for r in docs.collect() if not brute_hits(r.text, ITEMS[:1])[1]]
        assert sorted(map(repr, left.collect())) == sorted(map(repr, want))
        cut = decontaminate.remove_spans(docs, items, slice_words=slice_words)
        assert cut.columns == docs.columns and sorted(map(repr, cut.drop("text").collect())) == sorted(map(repr, docs.drop("text").collect()))


def test_spans_and_documents_go(spark, odd):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    left = decontaminate.remove_spans(odd, items)
    texts = [r.text for r in left.where("doc_id in (1, 5)").collect()]
    assert texts == ["one  thirteen fourteen"] * 3
    assert left.columns == odd.columns and left.where("doc_id = 2").first().text is None
    assert left.where("doc_id = 4").first().text == odd.where("doc_id = 4").first().text
    assert decontaminate.remove_documents(odd, items).count() == odd.count() - 3


# personal data

PII_CASES = {
    "a@b.c": [("email", 0, 5)],
    "a@b.c@d.e": [("email", 0, 5)],
    "x@@y.z a+b@c-d.e.f.": [("email", 7, 18)],
    "@b.c a@b": [],
    "1.2.3.4.5.6.7.8": [("ip", 0, 7), ("ip", 8, 15)],
    "256.1.1.1 1.1.1.256 001.002.003.004": [("ip", 20, 35)],
    "4111 1111-1111 1111": [("card", 0, 19)],
    "4111 1111 1111 1112": [],
    "4111  1111 1111 1111": [],
    "+1 (212) 555-0199": [("phone", 0, 17)],
    "+1-----": [],
    "+1234567 +12345678": [("phone", 9, 18)],
    "é +49 30 1234567.": [("phone", 2, 16)],
    "GB82 WEST 1234 5698 7654 32": [("iban", 0, 27)],
    "GB82 WEST 1234 5698 7654 33": [],
    "my ssn is 123-45-6789": [("ssn", 10, 21)],
    "part 123-45-6789": [],
    "call (212) 555-0199 now": [("local_phone", 5, 19)],
    "": [],
}


@pytest.mark.parametrize("text", PII_CASES)
def test_pii_spans(text):
    assert [(k, a, b) for k, a, b, _ in pii.find_spans(text)] == PII_CASES[text]


ES, AT, BE, PL = "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "BE68 5390 0754 7034", "PL61 1090 1014 0000 0712 1981 2874"


@pytest.mark.parametrize("number", [ES, AT, BE, PL, ES.replace(" ", ""), "GB82 WEST 1234 5698 7654 32"])
@pytest.mark.parametrize("after", ["", " BIC", " BIC CAIXESBB", " 2024", " EUR 100", " OK GO", " BIC GKCC BEBB", " A"])
def test_words_after_an_account_number(number, after):
    text = f"IBAN {number}{after}"
    assert [s[:3] for s in pii.find_spans(text) if s[0] == "iban"] == [("iban", 5, 5 + len(number))]
    assert pii.redact_text(text).startswith("IBAN <IBAN>")


def test_account_numbers_side_by_side():
    assert pii.redact_text(f"{BE} BE71 0961 2345 6769 {AT} {ES}") == "<IBAN> <IBAN> <IBAN> <IBAN>"
    assert pii.redact_text(f"AB12 CDEF GHIJ {ES} BIC") == "AB12 CDEF GHIJ <IBAN> BIC"
    assert pii.redact_text("ES91 2100 0418 4502 0005 1333 BIC") == "ES91 2100 0418 4502 0005 1333 BIC"


def test_account_numbers_of_other_countries():
    body = "XY00" + "12345678" * 2
    number = next(n for c in range(100) if pii.mod97(n := f"XY{c:02d}{body[4:]}"))
    assert pii.redact_text(f"{number} BIC CODE") == "<IBAN> BIC CODE"


def brute_base(text):
    out = {k: [] for k in pii.BASE_KINDS}
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or k == "phone" and not 8 <= len(digits) <= 15:
                continue
            out[k].append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="a1@.-+ (é", max_size=40), st.text(alphabet="01.+- 4", max_size=40)))
def test_pii_base_equals_plain_patterns(text):
    assert pii.base_spans(text) == brute_base(text)


def test_long_runs_take_linear_time():
    for run in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "@" * 200_000, "a@" * 100_000, "AB12" * 50_000, "password" * 25_000, "f" * 200_001, "eyJ" * 60_000):
        pii.find_spans(run)
        secrets.find_spans(run)


def test_pii_of_odd_rows(odd, nothing):
    got = pii.report(pii.find_pii(odd.withColumn("spans", F.lit(1)).withColumn("N_Email", F.lit(1)))).collect()
    assert len(got) == odd.count()
    for r in got:
        base = brute_base(r.text or "")
        spelled = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in base[k])
        # no span of an added kind is in these rows
        assert (r.base_sha256, r.spans, r.n_spans) == (sha(spelled), spelled, sum(map(len, base.values())))
        assert (r.n_email, r.n_phone) == ((3, 3) if r.doc_id is None else (0, 0))
    clean = pii.redact(odd)
    assert clean.columns == odd.columns
    assert clean.where("doc_id is null").first().text == "mail <EMAIL> or <PHONE> " * 3
    assert clean.where("doc_id = 2").first().text is None
    assert pii.redact(nothing).count() == pii.find_pii(nothing).count() == 0


def planted(seed, kinds, decoys, fill):
    """(text, spans): parts drawn from makers of spans and of decoys, set in filler words. What is found must be what was planted."""
    r = random.Random(seed)
    text, spans = "", []
    for _ in range(r.randrange(1, 7)):
        text += " ".join(r.choice(fill) for _ in range(r.randrange(1, 9))) + ". "
        lead, body, tail, kind = r.choice([*((*make(r), kind) for kind, make in kinds.items()), *((*make(r), None) for make in decoys)])
        if kind:
            spans.append((kind, len(text) + len(lead), len(text) + len(lead) + len(body)))
        text += lead + body + tail + ". "
    return text, spans


def iban(r, good=True):
    country, n = r.choice([("DE", 22), ("ES", 24), ("AT", 20), ("BE", 16), ("GB", 22), ("NO", 15)])
    body = "".join(r.choice("0123456789") for _ in range(n - 4))
    if country == "GB":
        body = "WEST" + body[4:]
    checked = next(f"{country}{c:02d}{body}" for c in range(98) if int("".join(str(int(x, 36)) for x in f"{body}{country}{c:02d}")) % 97 == 1)
    if not good:
        checked = checked[:-1] + str((int(checked[-1]) + 1) % 10)
    return "iban ", " ".join(checked[i : i + 4] for i in range(0, n, 4)) if r.random() < 0.5 else checked, ""


def ssn(r, good=True):
    area = r.choice([r.randrange(1, 666), r.randrange(667, 900)]) if good else r.choice([0, 666, 950])
    return "social security ", f"{area:03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}", ""


def local_phone(r, good=True):
    area = f"{r.randrange(2, 10)}{r.choice('02345678')}{r.choice('023456789')}" if good else r.choice(["911", "291", "123"])
    return "call ", r.choice([f"({area}) {{}}", f"{area}-{{}}", f"{area} {{}}"]).format(f"{r.randrange(2, 10)}{r.choice('0234')}7-{r.randrange(10000):04d}"), ""


PII_MAKERS = {"iban": iban, "ssn": ssn, "local_phone": local_phone}
PII_DECOYS = [lambda r: iban(r, False), lambda r: ssn(r, False), lambda r: local_phone(r, False), lambda r: ("part no serial ", ssn(r)[1], ""), lambda r: ("order ", local_phone(r)[1], "")]


@pytest.mark.parametrize("seed", range(150))
def test_added_pii_is_what_was_planted(seed):
    text, spans = planted(seed, PII_MAKERS, PII_DECOYS, ["éa", "over", "漢字", "lorem", "Ab", "🙂"])
    found = [s[:3] for s in pii.find_spans(text)]
    base = [x for kind in brute_base(text).values() for x in kind]
    spans = [s for s in spans if all(s[2] <= a or b <= s[1] for a, b in base)]  # digits of an account number may make a card number
    near = lambda w, s: bool(re.search(w, text[max(0, s[1] - pii.REACH) : s[1]] + " " + text[s[2] : s[2] + pii.REACH]))
    added = [s for s in found if s[0] in PII_MAKERS]
    # context words of a neighbour may lift a decoy or press a planted span: those in reach of one are left out
    clear = lambda s: not near("part|serial|order" if s in spans else "social|security|call", s)
    assert sorted(s for s in added if clear(s)) == sorted(s for s in spans if clear(s))
    assert all(s in added for s in spans if s[0] == "iban" and not near("part|serial", s))


def test_context_moves_scores():
    assert pii.find_spans("mail a@b.cd")[0][3] > pii.find_spans("qq a@b.cd")[0][3] > pii.find_spans("sample a@b.cd")[0][3]
    assert [s[:3] for s in pii.find_spans("version chapter 1.2.3.4")] == [("ip", 16, 23)]


def test_pii_whole_table(spark, sf_dir, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in queries()["op3_pii"](spark, sf_dir).collect():
        base = brute_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in pii.BASE_KINDS]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in base[k]))


# secrets


def der(*parts):
    body = b"".join(parts)
    return bytes([0x30, 0x82]) + len(body).to_bytes(2, "big") + body


def number(x):
    return bytes([0x02, len(x)]) + x


KEY = der(number(b"\x00"), *[number(bytes([i + 1]) * 60) for i in range(8)])
B64 = base64.b64encode(KEY).decode()
CLAIMS = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": 1})) + ".c2lnbmF0dXJl"


def token():
    body = "z" * 30
    n, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        tail = secrets._BASE62[d] + tail
    return "ghp_" + body + tail


SECRET_CASES = {
    'token = "abcdef"': [("assign", 0, 15)],
    "PassWord:abcde": [],
    "api-key=abcdef apikey=abcdef": [("assign", 15, 28)],
    "paſſword=abcdef": [],
    "AKIA" + "A" * 15: [],
    "xAKIA" + "A" * 16: [("access", 1, 21)],
    "f" * 23: [],
    "F" + "f" * 24: [("hex", 1, 25)],
    "secret=" + "0" * 24: [("assign", 0, 31), ("hex", 7, 31)],
    f"see {CLAIMS}": [("jwt", 4, 4 + len(CLAIMS))],
    "eyJub25l.eyJhIjoxfQ.abc": [],
    f"-----BEGIN RSA PRIVATE KEY-----\n{B64}\n-----END RSA PRIVATE KEY-----": [("pem", 0, 63 + len(B64) + 0)],
    f"-----BEGIN PRIVATE KEY-----\n{B64[:-9]}\n-----END PRIVATE KEY-----": [],
    f"blob {B64} end": [("der", 5, 5 + len(B64))],
    "M" + "I" * 60: [],
    f"{KEY.hex()}": [("hex", 0, 2 * len(KEY)), ("der_hex", 0, 2 * len(KEY))],
    f"use {token()}": [("checked_token", 4, 44)],
    f"use {token()[:-1]}!": [],
}


@pytest.mark.parametrize("text", SECRET_CASES)
def test_secret_spans(text):
    want = SECRET_CASES[text]
    if want and want[0][0] == "pem":
        want = [("pem", 0, len(text))]
    assert secrets.find_spans(text) == want


P256, CURVE = bytes.fromhex("06082a8648ce3d030107"), bytes.fromhex("06072a8648ce3d0201")
SHORT_KEYS = {
    "P-256 PKCS#8 without public key": bytes.fromhex("3041020100") + b"\x30\x13" + CURVE + P256 + bytes.fromhex("042730250201010420") + bytes(range(1, 33)),
    "P-256 SEC1 without public key": bytes.fromhex("30310201010420") + bytes(range(1, 33)) + b"\xa0\x0a" + P256,
    "Ed448 PKCS#8": bytes.fromhex("3047020100300506032b6571043b0439") + bytes(range(1, 58)),
}


@pytest.mark.parametrize("name", SHORT_KEYS)
def test_short_bare_keys(name):
    key = base64.b64encode(SHORT_KEYS[name]).decode()
    assert key[:2] in ("MD", "ME") and secrets.is_private_key(SHORT_KEYS[name])
    bare = key.rstrip("=")
    assert ("der", 5, 5 + len(key)) in secrets.find_spans(f"blob {key} end")
    assert ("der", 5, 5 + len(bare)) in secrets.find_spans(f"blob {bare} end")


@pytest.mark.parametrize("end", ["\\n", "\\r\\n", "\\\\n"])
def test_key_blocks_with_escaped_line_ends(end):
    block = f"-----BEGIN PRIVATE KEY-----{end}{B64[:64]}{end}{B64[64:]}{end}-----END PRIVATE KEY-----"
    assert secrets.find_spans(json.dumps({"a": 1})[:-1] + f', "k": "{block}"}}') == [("pem", 15, 15 + len(block))]


def test_hex_keys_in_either_case():
    key = KEY.hex()
    for text in (key.upper(), key[:200].upper() + key[200:], "d" + key.upper()):
        assert [s for s in secrets.find_spans(text) if s[0] == "der_hex"] == [("der_hex", len(text) - len(key), len(text))]
    assert [s for s in secrets.find_spans("D" + key) if s[0] == "der_hex"] == [("der_hex", 1, 1 + len(key))]


def lines(text, width, end="\n"):
    return end.join(text[i : i + width] for i in range(0, len(text), width))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n    "])
@pytest.mark.parametrize("width", [60, 64, 76])
def test_bare_keys_over_lines(width, end):
    for key in (B64, B64.rstrip("=")):
        body = lines(key, width, end)
        for text in (f"key:{end}{body}\n\nand so on", f"key:{end}{body}", f"{body}! {body}."):
            spans = [s for s in secrets.find_spans(text) if s[0] == "der"]
            assert [text[a:b] for _, a, b in spans] == [body] * text.count(body) and spans
    # cut short, or gone on with by what may be base64
    assert not [s for s in secrets.find_spans(lines(B64[:-20], width, end)) if s[0] == "der"]


ALGORITHM = bytes.fromhex("06092a864886f70d01050d")
ENCRYPTED = der(bytes([0x30, len(ALGORITHM) + 2]) + ALGORITHM + bytes.fromhex("0500"), bytes([0x04, 0x81, 0xA0]) + bytes(range(160)))


def test_encrypted_keys():
    body = base64.b64encode(ENCRYPTED).decode()
    block = f"-----BEGIN ENCRYPTED PRIVATE KEY-----\n{lines(body, 64)}\n-----END ENCRYPTED PRIVATE KEY-----"
    assert secrets.find_spans(f"a {block} b") == [("pem", 2, 2 + len(block))]
    assert ("der", 2, 2 + len(lines(body, 64))) in secrets.find_spans(f"a {lines(body, 64)} b")
    wrong = base64.b64encode(ENCRYPTED.replace(ALGORITHM, b"\x05" + ALGORITHM[1:])).decode()
    assert secrets.find_spans(block.replace(lines(body, 64), wrong)) == []


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n"])
def test_key_blocks_with_headers(end):
    body = lines(base64.b64encode(bytes(range(160))).decode(), 64, end)
    heads = f"Proc-Type: 4,ENCRYPTED{end}DEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF{end}{end}"
    block = lambda h, b: f"-----BEGIN RSA PRIVATE KEY-----{end}{h}{b}{end}-----END RSA PRIVATE KEY-----"
    found = lambda t: [s for s in secrets.find_spans(t) if s[0] == "pem"]
    text = block(heads, body)
    assert found(text) == [("pem", 0, len(text))]
    assert found(block("Comment: mine" + end, B64)) == [("pem", 0, len(block("Comment: mine" + end, B64)))]
    assert found(block(heads.replace("DEK-Info", "Other"), body)) == found(block(heads, body[:61])) == found(block("", body)) == []


@pytest.mark.parametrize("before", ["", "x", "xy", '{"tls.key": "'])
@pytest.mark.parametrize("width", [64, 76, 10**6])
def test_key_blocks_in_base64(before, width):
    block = f"-----BEGIN PRIVATE KEY-----\n{lines(B64, 64)}\n-----END PRIVATE KEY-----\n"
    coded = lines(base64.b64encode((before + block).encode()).decode(), width)
    assert secrets.find_spans(f"data: {coded}\n# end") == [("pem_base64", 6, 6 + len(coded))]
    more = base64.b64encode((before + block + "and more of it" * 9).encode()).decode()
    [(kind, a, b)] = secrets.find_spans(f"data: {more}")
    assert (kind, a) == ("pem_base64", 6) and base64.b64decode(more[: b - a] + "=" * (-(b - a) % 4)).decode("latin-1").strip().startswith((before + block)[:-1])
    assert secrets.find_spans("data: " + base64.b64encode((before + block.replace("M", "-", 1)).encode()).decode()) == []


def seconds(f, text):
    start = time.perf_counter()
    found = f(text)
    return time.perf_counter() - start, found


@pytest.mark.parametrize("name", ["secrets", "blocks", "pii", "wrapped", "headers"])
def test_many_candidates_take_linear_time(name):
    """100,000 candidates of the kinds that are held against one another; a fifth of them takes no less than an eleventh of the time."""
    short = base64.b64encode(SHORT_KEYS["Ed448 PKCS#8"]).decode()
    make = {
        "secrets": lambda n: f"{CLAIMS} {short} " * n, "blocks": lambda n: (base64.b64encode(b"-----BEGIN PRIVATE KEY-----" * 2).decode() + " ") * n,
        "pii": lambda n: "joe@example.com 12-34 DE89 3704 0044 0532 0130 00 or 123-45-6789 ssn " * n, "wrapped": lambda n: (B64[:60] + "\n") * n,
        "headers": lambda n: "-----BEGIN PRIVATE KEY-----\nA: b\n" * n,
    }[name]
    find = pii.find_spans if name == "pii" else secrets.find_spans
    seconds(find, make(100))
    less, few = seconds(find, make(20_000 if name != "wrapped" else 4000))
    more, many = seconds(find, make(100_000 if name != "wrapped" else 20_000))
    assert len(many) == 5 * len(few) and more < 11 * less + 1
    assert name not in ("secrets", "pii") or len(many) >= 200_000


def test_covered():
    r = random.Random(9)
    for _ in range(300):
        spans = [(a, a + r.randrange(1, 6)) for a in (r.randrange(40) for _ in range(r.randrange(6)))]
        some = textscan.Covered(spans)
        for a in range(42):
            for b in range(a + 1, a + 4):
                assert some.meets(a, b) == any(x < b and a < y for x, y in spans)


def test_every_sequence_is_decoded():
    assert all(base64.b64encode(bytes([0x30, second, 0])).decode().startswith(secrets._B64_STARTS) for second in range(256))


def jwt(r):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return "auth ", ".".join((part({"alg": r.choice(["HS256", "RS512"]), "n": r.random()}), part({"sub": r.randrange(999)}), part(r.random()))), ""


def bare_key(r):
    return "blob ", base64.b64encode(der(number(b"\x00"), *[number(r.randbytes(r.randrange(30, 60))) for _ in range(8)])).decode(), ""


def block(r):
    kind = r.choice(["", "RSA ", "EC "])
    return "", f"-----BEGIN {kind}PRIVATE KEY-----\n{bare_key(r)[1]}\n-----END {kind}PRIVATE KEY-----", ""


def checked(r):
    body = "".join(r.choice(secrets._BASE62) for _ in range(30))
    n, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        tail = secrets._BASE62[d] + tail
    return "use ", f"gh{r.choice('pousr')}_{body}{tail}", ""


SECRET_DECOYS = [
    lambda r: ("", "eyJ" + "x" * 20 + ".eyJhIjoxfQ.abc", ""), lambda r: ("", "M" + "I" * 70, ""), lambda r: ("", base64.b64encode(r.randbytes(80)).decode().replace("+", "a"), ""),
    lambda r: ("", "ghp_" + "a" * 36, ""), lambda r: ("", "-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----", ""), lambda r: ("", "30" + r.randbytes(40).hex().upper(), ""),
]


@pytest.mark.parametrize("seed", range(100))
def test_added_secrets_are_what_was_planted(seed):
    text, spans = planted(seed, {"jwt": jwt, "der": bare_key, "pem": block, "checked_token": checked}, SECRET_DECOYS, ["éa", "over", "漢字", "lorem", "🙂"])
    assert [s for s in secrets.find_spans(text) if s[0] not in secrets.BASE_KINDS] == spans


def test_secrets_of_tables(spark, sf_dir, documents, odd, nothing):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in queries()["op8_secrets"](spark, sf_dir).collect():
        t = texts[r.doc_id]
        a = [m.span() for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        b = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        c = [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans = sorted([(x, 0, y, "assign") for x, y in a] + [(x, 1, y, "access") for x, y in b] + [(x, 2, y, "hex") for x, y in c])
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (len(a), len(b), len(c), sha(",".join(f"{k}:{x}:{y}" for x, _, y, k in spans)))
    assert secrets.report(secrets.find_secrets(odd.withColumn("spans", F.lit(0)))).count() == odd.count()
    assert secrets.redact(nothing).count() == 0
    one = spark.createDataFrame([(1, 'a token = "abcdefgh" b'), (2, None)], "doc_id long, text string")
    assert sorted(map(str, (r.text for r in secrets.redact(one).collect()))) == ["None", 'a <SECRET>" b']


# tokenizer


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.mark.parametrize("table_size", [50, 400_000])
def test_encoding_equals_the_library(library, table_size):
    one = sentencepieces.Encoder(piece_model(), table_size=table_size)
    assert one.joined
    r = random.Random(3)
    letters = list("ab   ▁\n\t\x00é漢🙂<s>/<0x0A>﷽́")
    plain = [x for x in letters if x != "▁"]
    texts = ["", " ", "  ", "   ", "a ", "a  ", " a", "  a", "▁", "<s>", "a" * 100, *("".join(r.choice(x) for _ in range(r.randrange(25))) for x in (letters, plain, list("ab  ")) for _ in range(3000))]
    for column in (pa.array(texts), pa.array([t for t in texts if "▁" not in t]), pa.array([None, "x", None, "y z", "▁ a"])[1:]):
        found = one.run(column, decode=True, spell=True)
        for i, t in enumerate(column.to_pylist()):
            ids = library.encode(t or "")
            assert found.ids[found.ids_of[i] : found.ids_of[i + 1]].tolist() == ids
            assert (found.spelled[i].decode(), found.decoded[i].decode()) == (",".join(map(str, ids)), library.decode(ids) if ids else "")


def test_words_are_segmented_once(library):
    one = sentencepieces.Encoder(piece_model())
    asked, plain = Counter(), one.segment
    one.segment = lambda words: asked.update(words) or plain(words)
    r = random.Random(1)
    words = [f"word{i}" for i in range(50)]
    for _ in range(4):
        texts = [" ".join(r.choice(words) for _ in range(200)) for _ in range(30)]
        one.run(pa.array(texts))
    assert set(asked) == set(words) and set(asked.values()) == {1}


def test_decoding_reads_the_ids_alone(library):
    """Any ids, in any order: bytes that are no text, unknown and control pieces among them."""
    one, r = sentencepieces.Encoder(piece_model()), random.Random(6)
    n = library.get_piece_size()
    lists = [[], *([r.randrange(n if r.random() < 0.5 else 300) for _ in range(r.randrange(1, 12))] for _ in range(4000))]
    lists += [library.encode(t)[::-1] for t in ("the quick brown fox", "漢字 🙂﷽", "  a  b ")]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    flat = np.array([i for x in lists for i in x], np.int32)
    assert [x.decode() for x in one.decoded(flat, bounds)] == [library.decode(x) if x else "" for x in lists]


def test_a_wrong_id_is_seen(spark, library, monkeypatch):
    """Where the ids of a text are joined wrongly, the decoded text is another one and `exact` is false."""
    docs = spark.createDataFrame([(1, "the dog jumps over the lazy dog")], "doc_id long, text string")
    right = sentencepieces.round_trip(docs, piece_model()).first()
    one = sentencepieces.Encoder(piece_model())
    ids = np.array(library.encode(docs.first().text), np.int32)
    for wrong in (np.roll(ids, 1), np.concatenate((ids[:3], ids[4:])), np.where(np.arange(len(ids)) == 2, ids + 1, ids)):
        got = one.decoded(wrong, np.array([0, len(wrong)]))[0]
        assert sha(got.decode()) != right.decoded_sha256 and got.decode() == library.decode(wrong.tolist())
    found = one.run(pa.array([docs.first().text]), decode=True)
    assert found.decoded == [docs.first().text.encode()] and found.ids.tolist() == ids.tolist()
    shifted = sentencepieces.ranges
    monkeypatch.setattr(sentencepieces, "ranges", lambda a, b: shifted(a, b)[::-1])
    assert one.run(pa.array(["a b c"]), decode=True).decoded != [b"a b c"]


def test_other_models_go_to_the_library_whole(library):
    one = sentencepieces.Encoder(piece_model())
    one.joined = False
    texts = ["a b", "", "x  y"]
    found = one.run(pa.array(texts), decode=True, spell=True)
    for i, t in enumerate(texts):
        assert found.ids[found.ids_of[i] : found.ids_of[i + 1]].tolist() == library.encode(t) and found.decoded[i].decode() == t


def test_tokenizer_whole_table(spark, sf_dir, documents, library):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    rows = queries()["op6_sentencepiece"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_tokenizer_of_odd_rows(spark, odd, nothing, library):
    got = sentencepieces.round_trip(odd.withColumn("n_tokens", F.lit("clash")), piece_model()).collect()
    assert len(got) == odd.count()
    for r in got:
        ids = library.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    back = sentencepieces.decode(sentencepieces.encode(odd, piece_model()), piece_model()).collect()
    assert all(r.decoded == library.decode(library.encode(r.text or "")) for r in back)
    once = sentencepieces.encode_once(odd.withColumn("Token_Ids", F.lit(0)), piece_model()).collect()
    assert sorted((str(r.doc_id), list(r.token_ids)) for r in once) == sorted((str(r.doc_id), library.encode(r.text or "")) for r in odd.collect())
    for r in sentencepieces.reencode(odd, piece_model()).collect():
        assert list(r.token_ids) == library.encode(r.text or "") and r.exact == (library.decode(list(r.token_ids)) == (r.text or ""))
    assert sentencepieces.reencode(nothing, piece_model()).count() == sentencepieces.encode_once(nothing, piece_model()).count() == 0
    assert public_tokenizers.path("piece_bpe_32k.model") == piece_model()


# sharding


def check_law(rows, shards=sharding.SHARDS):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("bucket_bytes", [1 << 25, 5000])
def test_sharding_of_tables(odd, documents, nothing, bucket_bytes):
    out = sharding.shard(odd.withColumn("slot", F.lit("clash")), bucket_bytes=bucket_bytes).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in odd.collect())
    check_law(out)
    out = sharding.shard(documents, bucket_bytes=bucket_bytes * 20).collect()
    assert len({r.doc_id for r in out}) == len(out) == documents.count()
    check_law(out)
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.slot, r.shard))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3
    assert sharding.shard(nothing).count() == 0


def test_beginnings_equal_a_plain_sum(spark):
    r = random.Random(2)
    counts = {b: r.randrange(1, 9) for b in r.sample(range(300), 200)}
    rows = spark.createDataFrame([(b,) for b, n in counts.items() for _ in range(n)], "b int").repartition(4)
    table, n = sharding.beginnings(rows, "b", "first", level=7)
    at, want = 0, {}
    for b in sorted(counts):
        want[b] = at
        at += counts[b]
    assert n == 200 and {r.b: r.first for r in table.collect()} == want


@pytest.mark.parametrize("most", [0, 100])
def test_columns_go_along(spark, odd, monkeypatch, most):
    monkeypatch.setattr(sharding, "BROADCAST_BUCKETS", most)
    docs = odd.withColumn("_bucket", F.lit("mine")).withColumn("place", F.lit(4)).withColumn("SLOT", F.lit(1)).withColumn("a.b", F.lit(2))
    out = sharding.shard(docs, bucket_bytes=5000)
    assert out.columns == [*docs.drop("SLOT").columns, *sharding._OWN]
    check_law(out.collect())
    assert {(r._bucket, r.place) for r in out.collect()} == {("mine", 4)}


def test_shards_are_written_in_order(spark, documents, tmp_path):
    sharding.write_shards(sharding.shard(documents), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out/shard=3").select("slot").withColumn("f", F.input_file_name()).collect()
    by_file = {}
    for r in back:
        by_file.setdefault(r.f, []).append(r.slot)
    assert [s for f in sorted(by_file) for s in by_file[f]] == list(range(len(back)))


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, s).tolist()) for s in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850
