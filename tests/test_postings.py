"""The posting index: same rows as a scan, few files read."""

import random

import pytest

from tallyloom.operators import search
from tallyloom.sources import postings
from tallyloom.sources.tables import CATALOG, ITEMS

LETTERS = "abcdeABé %_ยา"


def named(seed, n):
    r = random.Random(seed)
    text = lambda a, b: "".join(r.choice(LETTERS) for _ in range(r.randrange(a, b)))
    return [(text(1, 6), text(0, 14) if r.random() < 0.9 else None) for _ in range(n)] + [("abcd", "abcd e"), ("ABC", "x"), ("q", "Abcde"), (None, "abcd"), ("abcd", "abcd e")]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(named(3, 600), CATALOG)


@pytest.fixture(scope="module")
def index(spark, catalog, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('postings')}/catalog"
    postings.write(catalog, path, "working_code", "drug_name")
    return postings.Postings(spark, path)


def rows(df):
    return [tuple(r) for r in df.collect()]


TERMS = ["", "a", "ab", "abc", "abcd", "bcd e", "zzz", "é", "%_", "ABCD", "e %", "ยาa", "abcd e", "x" * 40]


@pytest.mark.parametrize("term", TERMS)
def test_search_finds_what_a_scan_finds(catalog, index, term):
    assert rows(search.search_catalog(index.rows(term), term, 1000)) == rows(search.search_catalog(catalog, term, 1000))


@pytest.mark.parametrize("term", ["a_c", "abc%d", "%bcd%", "_abc_", "ab%cd", "%%%", "a_c bcd"])
def test_wildcards_find_what_a_scan_finds(catalog, index, term):
    assert rows(search.search_catalog(index.rows(term, True), term, 1000, wildcards=True)) == rows(search.search_catalog(catalog, term, 1000, wildcards=True))


def test_items(spark, tmp_path):
    items = spark.createDataFrame(named(5, 300), ITEMS)
    postings.write(items, f"file://{tmp_path}/items", "icode", "name")
    for term in TERMS:
        assert rows(search.search_items(postings.Postings(spark, f"file://{tmp_path}/items").rows(term), term, 1000)) == rows(search.search_items(items, term, 1000))
    postings.write(items.limit(0), f"file://{tmp_path}/items", "icode", "name")  # over what is there
    assert postings.Postings(spark, f"file://{tmp_path}/items").rows("abcd").count() == 0


def test_a_search_opens_one_folder(index, catalog):
    read = index.rows("abcd")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan or "PartitionFilters: [(block" in plan
    assert "EqualTo(run," in plan or "In(run," in plan
    folders = lambda df: {p for f in df.inputFiles() for p in f.split("/") if p.startswith("block=")}
    every = folders(index._table("postings"))
    assert len(every) > 100
    # the files that a scan is left with after its folders are chosen
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.selectedPartitions().partitionCount() == 1
    assert index._under("counts", ["abc", "bcd"])._jdf.queryExecution().executedPlan().collectLeaves().head().selectedPartitions().partitionCount() <= 2


def test_the_rarest_run_is_taken(spark, tmp_path):
    """A run that all rows have is not what a term is looked up by, if it has a rarer one."""
    rows_ = [(f"{i}", f"tablet {i:04d} mg") for i in range(500)]
    postings.write(spark.createDataFrame(rows_, CATALOG), f"file://{tmp_path}/c", "working_code", "drug_name")
    one = postings.Postings(spark, f"file://{tmp_path}/c")
    assert one.rarest("tablet 0042") == ("004", 11) and one.rarest("tab") == ("tab", 500) and one.rarest("ta") is None
    assert one.rarest("qqq") == ("qqq", 0) and one.rarest("t_b%let", wildcards=True) == ("let", 500)
    assert one.rows("tablet 0042").count() == 11 and one.rows("qqq").count() == 0
