import pytest
from pyspark.sql import functions as F

from tallyloom.functions import names

# FIXTURES.md section 4 (names, equal spellings, brackets, scores, terms, escapes, edit distances).
NORMALIZED = [
    ("Amoxicillin 500 mg", "amoxicillin"), ("Amoxicillin 500mg", "amoxicillin"), ("Amoxicillin500mg", "amoxicillin"), ("Amoxicillin (500 mg)", "amoxicillin"),
    ("แอมม็อกซิซิลลิน 500 มิลลิกรัม", "แอมม็อกซิซิลลิน"), ("แอมม็อกซิซิลลิน 500 มก. แคปซูล", "แอมม็อกซิซิลลิน"),
    ("พาราเซตามอล 500 มก. (ยาเม็ด)", "พาราเซตามอล"), ("พาราเซตามอล ๕๐๐ มก.", "พาราเซตามอล"),
    ("Omeprazole 20 mg (โอเมพราโซล)", "omeprazole โอเมพราโซล"), ("Amoxicillin (แอมม็อกซิซิลลิน 500 มก.)", "amoxicillin แอมม็อกซิซิลลิน"),
    ("Paracetamol (พาราเซตามอล 500 mg)", "paracetamol พาราเซตามอล"), ("พาราเซตามอล paracetamol", "paracetamol พาราเซตามอล"),
    ("", ""), ("500 mg", ""), (None, ""),
]
EQUAL = [("บรรจุ", "บรจุ"), ("สรรพคุณ", "สรพคุณ"), ("ธารา", "ธาร"), ("ตรึม", "ตริม"), ("vitamin C", "c vitamin"), ("ยา ๑๒๓", "ยา 123"), ("โดมเพอริดอน 10 มก.", "โดมเพอริดอน 10mg")]
BRACKETS = [("a(b(c)d)e", "a c de"), ("abc(def", "abcdef"), ("amox(500mg)icillin", "amoxicillin"), ("x) y", "x) y")]
SCORES = [
    ("Amoxicillin 500 mg", "Amoxicillin 500mg", 1.0), ("พาราเซตามอล 500 มก.", "พาราเซตามอล 500 มิลลิกรัม", 1.0), ("Paracetamol (พาราเซตามอล)", "พาราเซตามอล paracetamol", 1.0),
    ("Aspirin 81 mg", "Aspirin 325 mg", 1.0), ("Paracetamol + Codeine", "Paracetamol", 0.75), ("Amoxicillin", "Amoxicillin + Clavulanate", 0.75), ("", "Amoxicillin", 0.0), ("500 mg", "Amoxicillin", 0.0),
]
TERMS = [("Amoxicillin 500 mg", "Amoxicillin"), ("Ab 500 mg", "Ab 500"), ("a very long name here", "a very"), ("  ", ""), (None, ""), ("abcdefghijklmnopqrstuv", "abcdefghijklmnop")]
DISTANCES = [("kitten", "sitting", 3), ("equal", "equal", 0), ("", "abc", 3)]
#: Cases of our own.
OWN = [("Drug  (5 mg)(10 mg) forte", "drug forte"), ("ยาน้ำ 5 มล.", ""), ("A-B/c", "a b c"), ("µg x 1", "x")]
LIKE = [("50%", "50~%"), ("a_b", "a~_b"), ("100~", "100~~"), ("%_~%", "~%~_~~~%")]


def one(spark, rows, f, kind="string"):
    df = spark.createDataFrame(rows, ", ".join(f"c{i} {kind}" for i in range(len(rows[0]))))
    return [r[0] for r in df.select(f(*[F.col(c) for c in df.columns])).collect()]


def test_normalized(spark):
    assert one(spark, [(a,) for a, _ in NORMALIZED], names.normalized) == [b for _, b in NORMALIZED]


def test_equal_spellings(spark):
    assert one(spark, [(a,) for a, _ in EQUAL], names.normalized) == one(spark, [(b,) for _, b in EQUAL], names.normalized)


def test_brackets(spark):
    assert [" ".join(x.split()) for x in one(spark, [(a,) for a, _ in BRACKETS], names.open_brackets)] == [b for _, b in BRACKETS]


def test_scores(spark):
    assert one(spark, [(a, b) for a, b, _ in SCORES], names.similarity) == pytest.approx([s for _, _, s in SCORES])
    assert 0 <= one(spark, [("Ciprofloxacin 500 mg", "Cefixime 100 mg")], names.similarity)[0] < 0.5


def test_terms_and_escapes(spark):
    assert one(spark, [(a,) for a, _ in TERMS], names.search_term) == [b for _, b in TERMS]
    assert one(spark, [(a,) for a, _ in LIKE], names.escape_like) == [b for _, b in LIKE]


def test_cases_of_our_own(spark):
    assert one(spark, [(a,) for a, _ in OWN], names.normalized) == [b for _, b in OWN]


def test_edit_distances(spark):
    assert one(spark, [(a, b) for a, b, _ in DISTANCES], F.levenshtein) == [d for _, _, d in DISTANCES]
    # names without a common token are held by edit distance
    assert one(spark, [("kitten", "sitting")], names.similarity) == [pytest.approx(1 - 3 / 7)]
