"""CSV files read in parallel against the same text pasted."""

import random

import pytest

from tallyloom.operators import bulk
from tallyloom.sources import csv_files

FIELDS = ["line", "physical_line", "icode", "working_code", "dispensed_name", "purchased_name"]
LETTERS = ['"', '""', '"a', 'b"', ",", " ", "a", "ยา", "\n", "\r\n", "\r", "icode,code\n", "\n1,2\n", '\n1,"x\ny",z\n']


def random_text(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(LETTERS) for _ in range(n))


def put(folder, texts):
    folder.mkdir()
    for i, t in enumerate(texts):
        (folder / f"part-{i:03d}.csv").write_bytes(t.encode())
    return f"file://{folder}"


def held(spark, path, texts):
    """Rows and errors of files against those of each text pasted; ordinals go on from file to file."""
    rows, errors = csv_files.read(spark, path)
    want, wrong, n = [], [], 0
    for i, t in enumerate(texts):
        mine, bad = bulk.parse(t)
        want += [(i, r[0] + n, *r[1:]) for r in mine]
        wrong += [(i, *e) for e in bad]
        n += len(mine)
    number = lambda r: int(r.file.rsplit("part-", 1)[1][:3])
    assert sorted((number(r), *[r[c] for c in FIELDS]) for r in rows.collect()) == want
    assert sorted((number(r), r.physical_line, r.message) for r in errors.collect()) == wrong


@pytest.fixture
def small_splits(spark):
    """Splits of some bytes, so that records lie across them."""
    names = {"spark.sql.files.maxPartitionBytes": "37", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(6))
def test_files_equal_pasted_texts(spark, tmp_path, small_splits, seed):
    texts = [random_text(seed * 10 + i, 120) for i in range(3)]
    held(spark, put(tmp_path / "in", texts), texts)


def test_long_quotes_over_many_splits(spark, tmp_path, small_splits):
    texts = ['1,W1,"' + "line, of text\n" * 40 + '",x\n2,W2\n\n3\n4,W4,"open ' + "and on\n" * 30, "", "\n\n", "icode,code\n5,W5"]
    held(spark, put(tmp_path / "in", texts), texts)
    rows, errors = csv_files.read(spark, f"file://{tmp_path}/in")
    assert [(r.line, r.physical_line) for r in rows.orderBy("line").collect()] == [(1, 1), (2, 42), (3, 45), (4, 2)]
    assert [r.message for r in errors.collect()] == ["line 44: two columns are needed, icode and working_code"]


@pytest.mark.parametrize("broadcast", [-1, 10 << 20])
def test_rows_in_order_however_they_are_joined(spark, tmp_path, small_splits, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        texts = [random_text(99, 400)]
        held(spark, put(tmp_path / "in", texts), texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_open_after():
    cases = {'a,b\n': False, '"a\n': True, 'a,"b\n': True, 'a"b\n': False, '"a""\n': True, '"a""b",c\n': False, '"a"b"c\n': False, ' "a\n': True, 'a, "b\n': True, '"a" "b\n': False}
    assert {k: csv_files.open_after(k, False) for k in cases} == cases
    assert csv_files.open_after('a","b\n', True) and not csv_files.open_after('a",b\n', True) and csv_files.open_after('""\n', True)


def test_nothing_goes_through_the_driver(spark, tmp_path):
    """No text is collected while the reading is planned: the lines are read by tasks of the result alone."""
    path = put(tmp_path / "in", ["1,2\n" * 50])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("csv", "plan only")
    try:
        rows, _ = csv_files.read(spark, path)
        assert not tracker.getJobIdsForGroup("csv") and rows.count() == 50
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
