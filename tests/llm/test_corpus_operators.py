"""Near duplicates, substring dedup, quality rules, the classifier, page extraction and the pipeline."""

import collections
import gc
import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import components, html_blocks, html_extract, jaccard, quality_model, quality_rules, repeats, textscan
from tallyloom.llm.common import clear_scratch, materialize
from tallyloom.llm.queries import queries

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# near duplicates


def shingles(text, width):
    w = WHITE.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, rule):
    sets = [(d, shingles(t, rule.width)) for d, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and rule.q * len(a & b) >= rule.p * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, s) in enumerate(sets):
        if s and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))


def near_copies(seed, n, base=120, common=0):
    """Texts of a few families with words changed, some copied, some sharing a passage."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(common)]
    families = [[f"w{r.randrange(400)}" for _ in range(r.randrange(base // 3, base))] for _ in range(4)]
    out = []
    for i in range(n):
        words = list(r.choice(families)) if r.random() < 0.7 else [f"v{r.randrange(500)}" for _ in range(r.randrange(1, base))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 12])):
            words[r.randrange(len(words))] = f"z{r.randrange(999)}"
        out.append((i, " ".join(words + passage * (r.random() < 0.6))))
    return out


@pytest.mark.parametrize("rule", [jaccard.Rule(3, 90, 100), jaccard.Rule(), jaccard.Rule(2, 1, 2), jaccard.Rule(1, 1, 1)])
@pytest.mark.parametrize("group_tokens, common", [(2_000_000, 0), (600, 40)])
def test_components_equal_brute_force(spark, rule, group_tokens, common):
    rows = near_copies(7, 140, common=common)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.components(df, rule=rule, group_tokens=group_tokens).collect()
    assert collections.Counter(map(tuple, got)) == brute_components(rows, rule)


def test_one_partition_of_many_near_copies(spark):
    """A chain of copies whose ends do not link, texts that share a passage only, and a second family, dealt into one group, some and many."""
    r = random.Random(11)
    base, other = [f"w{i}" for i in range(100)], [f"u{i}" for i in range(100)]
    rows, now = [], list(base)
    for i in range(160):
        now = list(now)
        if i % 4 == 0:
            now[r.randrange(100)] = f"z{i}"
        copy = list(now)
        copy[r.randrange(100)] = f"y{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(base[:40] + [f"q{i}_{j}" for j in range(60)])) for i in range(40)]
    rows += [(2000 + i, " ".join(other[:50] + [f"x{i}"] + other[51:])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rule = jaccard.Rule(3, 80, 100)
    for most in (1_000_000, 900, 300):
        got = jaccard.components(df, rule=rule, group_tokens=most).collect()
        assert collections.Counter(map(tuple, got)) == brute_components(rows, rule)


def passages_in_a_row(n):
    """Texts of which each shares a passage with the next and one with the text before, every tenth with a near copy."""
    passage = lambda i: [f"p{i}_{j}" for j in range(60)]
    rows = [(i, " ".join([*passage(i), *[f"o{i}_{j}" for j in range(180)], *passage(i + 1)])) for i in range(n)]
    return rows + [(n + i, f"{t} near{i}") for i, t in rows[::10]]


def test_texts_that_share_passages_only_are_not_fetched(spark, monkeypatch):
    """They all come to one partition by their slices; left in it, each would be held against the others."""
    rows, seen, real = passages_in_a_row(200), [], jaccard._dealt
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "_dealt", lambda rows, by, most: seen.append(rows.count()) or real(rows, by, most))
    got = jaccard.components(df, rule=jaccard.Rule(), group_tokens=500).collect()
    assert collections.Counter(map(tuple, got)) == brute_components(rows, jaccard.Rule())
    assert seen[0] <= 60, seen  # 20 texts and their near copies, and what their neighbours keep


def test_near_duplicates_leave_one_scratch_table_a_step(spark):
    """What only led to the groups is deleted when these are written; the rows stay the same."""
    rows = passages_in_a_row(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clear_scratch(spark)
    kept = jaccard.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert clear_scratch(spark) <= 3


def test_equal_edges_collapse_at_once(spark, monkeypatch):
    """Each edge stands in many tasks of slices: one round brings equal edges together, and none go through propagation."""
    pairs = [(2 * i, 2 * i + 1) for i in range(300)]
    edges = spark.createDataFrame(pairs * 8, "a long, b long").repartition(8)
    monkeypatch.setattr(components, "_propagated", lambda one: pytest.fail(f"{one.count()} edges are left"))
    got = components.connected(edges, forest_edges=320).collect()
    assert {r.node: r.root for r in got} == {x: a for a, b in pairs for x in (a, b)}


def test_hot_slices_come_once_a_batch():
    cls = np.arange(1000)
    code = np.concatenate((np.full(1000, 7, np.uint64), np.arange(100, 1100, dtype=np.uint64)))
    out = jaccard._sent(code, np.concatenate((cls, cls)), 4)
    kinds = out.column(0).to_pylist()
    assert kinds.count(jaccard.EDGES) == 1 and sum(len(b) // 16 for k, b in zip(kinds, out.column(2).to_pylist(), strict=True) if k == jaccard.SLICES) == 1001


def shuffle_files(spark):
    """Bytes of each shuffle file that Spark has on disk now."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f: f.stat().st_size for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*.data")}


def test_blocks_of_slices_take_eleven_bytes_a_slice():
    r = np.random.default_rng(2)
    code, cls = np.sort(r.integers(0, 1 << 63, 999).astype(np.uint64) * np.uint64(2)), r.integers(-(1 << 63), 1 << 63 - 1, 999)
    names = jaccard.name_of(cls)
    assert (names >= 0).all() and (names == (cls >> 24) % (1 << 40)).all()
    blob = jaccard.packed(code.tobytes() + names.tobytes())
    assert len(blob) == 11 * 999
    got = jaccard.unpacked(blob)
    assert (got[0] == code >> np.uint64(16)).all() and (got[1] == names).all()


def test_classes_of_one_name_are_told_apart(spark, monkeypatch):
    """All classes get one name, so all come to one partition."""
    rows = near_copies(5, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    real, calls, named = jaccard.connected, [], F.shiftrightunsigned
    monkeypatch.setattr(jaccard.F, "shiftrightunsigned", lambda c, n: named(c, n) * 0)
    monkeypatch.setattr(jaccard, "connected", lambda edges: real(edges) if calls.append(1) or len(calls) > 1 else spark.createDataFrame([(0, 0)], "node long, root long"))
    assert collections.Counter(map(tuple, jaccard.components(df).collect())) == brute_components(rows, jaccard.Rule())


def test_scratch_tables_leave_no_shuffle_files(spark):
    before = set(shuffle_files(spark))
    made = materialize(spark.range(1000).selectExpr("id", "id % 7 as `a.b`").repartition(3, "id"))
    assert made.count() == 1000
    gc.collect()
    for _ in range(50):
        if not (left := {f for f in set(shuffle_files(spark)) - before if f.stat().st_size > 1000}):
            break
        time.sleep(0.1)
    assert not left


def test_rows_that_stay_are_not_moved(spark):
    """Rows without near copies reach the result without a shuffle, however many rows go and however wide they are."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    texts = [" ".join(f"{n}_{i}" for i in range(60)) for n in range(60)] + [a, a, b, b + " near"]
    wide = F.base64(F.to_binary(F.concat(*[F.sha2(F.concat("text", F.lit(str(i))), 512) for i in range(400)]), F.lit("hex")))
    docs = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("wide", wide).withColumn("when", F.current_timestamp()))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        kept = jaccard.drop_near_duplicates(docs)
        files = set(shuffle_files(spark))
        got = kept.collect()
        moved = sum(n for f, n in shuffle_files(spark).items() if f not in files)
    finally:
        spark.conf.set(threshold, before)
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in docs.collect() if r.doc_id not in (61, 63))
    assert moved < 10 * len(got[0].wide), moved


def test_join_query_equals_brute_force(spark, sf_dir, documents):
    got = queries()["op5_jaccard_join"](spark, sf_dir).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components([(r.doc_id, r.text) for r in documents.collect()], jaccard.Rule(3, 90, 100))


def test_null_ids_keep_their_links_however_rows_are_split(spark):
    """Their keys come from the text, and a class that has an id goes by that; texts that come again are fetched once a batch."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words[:39] + ["x"]), " ".join(words[::-1])]
    rows = [(None, texts[0])] * 50 + [(None, texts[1])] * 50 + [(9, texts[1]), (9, texts[1]), (8, texts[2]), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = [sorted(r.key for r in jaccard._keyed(d, "doc_id", "text").collect()) for d in (docs.coalesce(1), docs.repartition(5), docs.orderBy(F.rand(3)))]
    assert keys[0] == keys[1] == keys[2] and len({k for k in keys[0] if k < 0}) == 3
    for d in (docs.coalesce(1), docs.repartition(7)):
        got = jaccard.components(d, rule=jaccard.Rule(3, 90, 100)).collect()
        assert collections.Counter((r.doc_id, r.component_id) for r in got) == {(None, 9): 100, (9, 9): 2, (8, 8): 1, (None, None): 1}
    members = spark.createDataFrame([(-5,), (7,)], "key long")
    asked = spark.createDataFrame([(-5, "a"), (-5, "a"), (-5, "b"), (7, "c"), (7, "c"), (8, "d")], "key long, text string").coalesce(1)
    found = collections.Counter(map(tuple, jaccard._sifted(asked, jaccard._marks(members)).collect()))
    assert {k: found[k] for k in ((-5, "a"), (-5, "b"), (7, "c"))} == {(-5, "a"): 1, (-5, "b"): 1, (7, "c"): 1}


def test_components_of_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = jaccard.components(odd.withColumn("n", F.lit(1)).withColumn("cls", F.lit("x")), rule=jaccard.Rule(3, 90, 100)).collect()
    assert collections.Counter(map(tuple, got)) == brute_components(rows, jaccard.Rule(3, 90, 100))
    assert jaccard.components(nothing).count() == 0
    kept = jaccard.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "7", "8", "9"])


def test_slices_of_linked_sets_meet():
    """Any two sets that reach the similarity share a slice."""
    r = np.random.default_rng(1)
    for rule in (jaccard.Rule(3, 90, 100), jaccard.Rule()):
        for _ in range(300):
            n = int(r.integers(2, 300))
            a = r.integers(1, 1 << 62, n).astype(np.uint64)
            cut, more = int(r.integers(0, max(1, n // 8))), int(r.integers(0, max(1, n // 8)))
            b = np.concatenate((a[cut:], r.integers(1, 1 << 62, more).astype(np.uint64)))
            both = n - cut
            if rule.links(np.array(both), np.array(n), np.array(len(b))) and (cut or more):
                sizes = np.array([n, len(b)])
                code, owner = jaccard.slice_codes(np.concatenate((np.sort(a), np.sort(b))), sizes, sizes, rule)
                assert set(code[owner == 0]) & set(code[owner == 1])


def test_long_chains_connect(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (501, 500), (600, 600), (None, 3)], "a long, b long")
    want = {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 600: 600}
    for most in (2_000_000, 60, 10):  # one task, forests of forests, label propagation
        assert {r.node: r.root for r in components.connected(edges, forest_edges=most).collect()} == want
    assert components.connected(edges.limit(0)).count() == 0


# substring dedup


def brute_repeats(rows, depth):
    least = {}
    words = [(d, WHITE.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - depth + 1 if d is not None else 0):
            k = tuple(w[i : i + depth])
            least[k] = min(d, least.get(k, d))
    out = collections.Counter()
    for d, w in words:
        gone = set()
        for i in range(len(w) - depth + 1 if d is not None else 0):
            if least[tuple(w[i : i + depth])] < d:
                gone |= set(range(i, i + depth))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("depth, group", [(13, 750_000), (3, 40), (1, 5), (5, 200)])
def test_repeats_equal_brute_force(spark, depth, group):
    rows = near_copies(3, 60, base=60, common=25) + [(70, "a a a a a a a a a a"), (71, "a a a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeats.report(df, depth=depth, group_suffixes=group).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == brute_repeats(rows, depth)


def test_hot_passages_and_ids(spark, monkeypatch):
    """A passage that most documents share, slots too full at the last prefix, few known codes, and an id that a third of the rows share."""
    passage = " ".join(f"p{i}" for i in range(30))
    r = random.Random(9)
    rows = [(i if i % 3 else 77, f"{i} " + " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(30))) + f" {passage} " + f"t{r.randrange(5)}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for known, held in ((1 << 18, 4_000_000), (10, 7)):
        monkeypatch.setattr(repeats, "KNOWN_CODES", known)
        monkeypatch.setattr(repeats, "HELD_HITS", held)
        got = repeats.report(df, depth=5, group_suffixes=20).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert collections.Counter(map(tuple, got)) == brute_repeats(rows, 5)


def test_plans_split_full_slots():
    counts = np.zeros((2, 8), np.int64)
    counts[0] = [5, 5, 30, 0, 5, 0, 0, 0]
    counts[1] = [9, 0, 25, 1, 0, 10, 0, 0]
    task, ways, tasks = repeats.plan_groups(counts, 10)
    assert (task[0] >= 0).tolist() == [True, True, False, True, True, True, True, True] and (task[1] >= 0).all()
    assert ways[1].tolist() == [1, 1, 3, 1, 1, 1, 1, 1] and tasks == 1 + (task + ways).max() - 1
    load = np.zeros(tasks)
    for i in range(2):
        for s in range(8):
            if task[i, s] >= 0:
                load[task[i, s] : task[i, s] + ways[i, s]] += counts[i, s] / ways[i, s]
    assert load.max() <= 20


def test_windows_of_one_code_go_to_different_tasks():
    """Word hashes are bent so that two different windows share the code: their tasks are still chosen independently."""
    rng, depth, n = np.random.default_rng(5), repeats.DEPTH, 2000
    one = rng.integers(0, 1 << 63, (n, depth), dtype=np.uint64)
    other = one.copy()
    other[:, 0] += np.uint64(1)
    other[:, 1] -= np.uint64(0xD6E8FEB86659FD93)  # the factor of the sum: what the first word adds, the second takes away
    flat, bent, at = one.ravel(), other.ravel(), np.arange(n) * depth
    assert (textscan.rolled(flat, depth)[at] == textscan.rolled(bent, depth)[at]).all() and (one != other).any(axis=1).all()
    depths, slots = repeats.prefix_depths(depth), 16
    counts = np.full((len(depths), slots), 6400)
    task, ways, tasks = repeats.plan_groups(counts, 100)
    assert tasks == slots * 64 and (ways[-1] == 64).all()
    mine, its = (repeats._tasks_of(h, at, depths, task, ways) for h in (flat, bent))
    assert (mine == its).sum() < 20  # two of 2,000 expected
    again = repeats._tasks_of(np.concatenate((flat, flat)), np.arange(2 * n) * depth, depths, task, ways)
    assert (again[:n] == mine).all() and (again[n:] == mine).all()  # equal windows meet
    assert len(np.unique(mine)) > 800 and mine.min() >= 0 and mine.max() < tasks


def test_repeats_of_odd_rows(odd, nothing, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = repeats.report(odd.withColumn("n_words", F.lit("clash")).withColumn("kind", F.lit(3))).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == brute_repeats(rows, 13)
    assert repeats.report(nothing).count() == 0
    left = repeats.remove_repeats(odd)
    assert left.columns == odd.columns and [r.text for r in left.where("doc_id = 5").collect()] == ["", ""]
    other = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c"), (2, "y y y y y y")], "doc_id long, text string")
    assert sorted(r.text for r in repeats.remove_repeats(other, depth=3).collect()) == ["a b c d e", "x", "y y y y y y"]


def test_repeats_are_maximal(spark):
    rows = [(1, "a b c d e f g"), (2, "x b c d e y c d e f")]
    got = {r.doc_id: r.repeats for r in repeats.report(spark.createDataFrame(rows, "doc_id long, text string"), depth=3).collect()}
    assert got == {1: [], 2: [[1, 5], [6, 10]]}


# quality rules


def brute_statistics(text):
    w = WHITE.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered, seen, dup = collections.Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if WHITE.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_statistics_equal_brute_force(spark, odd, documents):
    more = spark.createDataFrame([(100, "a b c a b c a b c\n\n \nx\nx\nx \n<#>|"), (101, "a a a"), (102, "a a a a"), (103, "a b")], "doc_id long, text string")
    for df in (odd, documents, more.selectExpr("doc_id", "text", "'en' lang", "'s' source")):
        stats = quality_rules.statistics(df).collect()
        got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in stats)
        assert got == collections.Counter((r.doc_id, *brute_statistics(r.text)) for r in df.collect())


def brute_estimate(x, support, starts=60):
    """The smallest regularised determinant of many random starts, each brought to convergence, then reweighted once."""
    floor, p = np.diag([quality_rules.FLOORS[f] for f in quality_rules.FEATURES]), x.shape[1]
    r = np.random.default_rng(0)
    h, best = int(np.ceil(support * len(x))), (np.inf, None, None)

    def distance(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    for _ in range(starts):
        few = x[r.choice(len(x), 2 * (p + 1), replace=False)]
        mean, cov, last = few.mean(axis=0), np.cov(few.T, bias=True) + floor, np.inf
        while True:
            near = x[np.argsort(distance(mean, cov), kind="stable")[:h]]
            mean, cov = near.mean(axis=0), quality_rules.widening(support) * np.cov(near.T, bias=True) + floor
            det = np.linalg.slogdet(cov)[1]
            if det >= last - 1e-9:
                break
            last = det
        if det < best[0]:
            best = (det, mean, cov)
    within = x[distance(*best[1:]) <= 12.832502]
    return best[0], within.mean(axis=0), quality_rules.widening(0.975) * np.cov(within.T, bias=True) + floor


def test_quantiles():
    assert quality_rules.chi_square_quantile(0.975, 5) == pytest.approx(12.832502, abs=1e-5)
    assert quality_rules.chi_square_quantile(0.5, 1) == pytest.approx(0.454936, abs=1e-5)
    r = np.random.default_rng(1).normal(size=(400_000, 5))
    d = (r * r).sum(axis=1)
    near = r[d <= np.quantile(d, 0.75)]
    assert quality_rules.widening(0.75) == pytest.approx(1 / near.var(axis=0).mean(), rel=0.01)


@pytest.fixture(scope="module")
def clouds(spark):
    """Documents of two shapes and a few far ones, in one language and source."""
    r = random.Random(5)
    rows = [(i, " ".join("w" * r.randrange(1, 12) + r.choice(["", "", "#", "A"]) + str(r.randrange(60)) for _ in range(r.randrange(60, 200))), "en", "s") for i in range(300)]
    rows += [(500 + i, " ".join("V" * r.randrange(3, 6) + str(r.randrange(900)) for _ in range(r.randrange(60, 200))), "en", "s") for i in range(70)]
    rows += [(1000 + i, "$$$ ## " * 60 + str(i) + " " + " ".join(str(r.random()) for _ in range(200)), "en", "s") for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def units(df):
    stats = quality_rules.statistics(df).select("doc_id", *[c.alias(k) for k, c in quality_rules._features().items()]).collect()
    return {x.doc_id: np.round(np.array(list(x[1:])) * quality_rules.UNIT) / quality_rules.UNIT for x in stats}


def test_estimate_equals_numpy(spark, clouds):
    got = {x.doc_id: x for x in quality_rules.quality_rules(clouds).collect()}
    x = units(clouds)
    good = [d for d in x if not got[d].base_failed]
    every = np.array([x[d] for d in good])
    det, mean, cov = brute_estimate(every, quality_rules.SUPPORT)
    want = np.einsum("ij,jk,ik->i", every - mean, np.linalg.inv(cov), every - mean)
    assert np.allclose([got[d].distance2 for d in good], want, rtol=0.1, atol=0.05)
    cut = quality_rules.chi_square_quantile(quality_rules.QUANTILE, 5)
    clear = np.abs(want / cut - 1) > 0.1
    assert (np.array([got[d].kept for d in good]) == (want <= cut))[clear].all()
    assert not any(got[d].kept for d in good if d >= 1000) and any(d >= 1000 for d in good)
    rows = spark.createDataFrame([("*", d, *(int(v) for v in np.round(x[d] * quality_rules.UNIT))) for d in good], "grp string, id long, " + ", ".join(f"{f} long" for f in quality_rules.FEATURES))
    found = quality_rules.estimate(rows)[0].first()
    assert found.logdet == pytest.approx(det, abs=0.05)


def numpy_step(x, inverse, mean, support):
    """One concentration step: the nearest share, to the edge of its bin of distance."""
    d = np.square((x - mean) @ inverse.T).sum(axis=1)
    bins = np.floor(quality_rules.BINS * np.log2(1 + 1024 * d))
    edge = np.sort(bins)[int(np.ceil(support * len(x))) - 1]
    return moments(x[bins <= edge], quality_rules.widening(support))


def moments(x, factor):
    """(log determinant, mean, covariance, inverse of its Cholesky factor)."""
    cov = factor * np.cov(x.T, bias=True) + np.diag([quality_rules.FLOORS[f] for f in quality_rules.FEATURES])
    low = np.linalg.cholesky(cov)
    return 2 * np.log(np.diag(low)).sum(), x.mean(axis=0), cov, np.linalg.inv(low)


@pytest.mark.parametrize("start_steps", [quality_rules.START_STEPS, 0])
def test_steps_equal_numpy_from_the_same_starts(spark, clouds, start_steps, monkeypatch):
    """Three groups at once, each with the starts that its hashes choose: determinants, means and covariances to 1e-9."""
    monkeypatch.setattr(quality_rules, "START_STEPS", start_steps)
    x = units(clouds)
    groups = {"a": [d for d in x if d < 300], "b": [d for d in x if d >= 400], "c": list(x)}
    data = [(g, d, *(int(v) for v in np.round(x[d] * quality_rules.UNIT))) for g, ids in groups.items() for d in ids]
    rows = spark.createDataFrame(data, "grp string, id long, " + ", ".join(f"{f} long" for f in quality_rules.FEATURES))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("size"))
    part, few = quality_rules._chosen(rows, sizes, 3, quality_rules.STARTS)
    sets = collections.defaultdict(list)
    for r in few.collect():
        sets[r.grp, r.start].append(r.id)
    assert part.count() == rows.count()  # of fewer than START_ROWS documents all are the part
    found = {r.grp: r for r in quality_rules.estimate(rows)[0].collect()}
    steps = []
    for g, ids in groups.items():
        every = np.array([x[d] for d in ids])
        best = None
        for start in range(quality_rules.STARTS + 1):
            some = every if start == 0 else np.array([x[d] for d in sets[g, start]])
            if not len(some):
                continue
            now = moments(some, 1.0)
            for _ in range(quality_rules.START_STEPS):
                now = numpy_step(every, now[3], now[1], quality_rules.SUPPORT)
            best = now if best is None or now[0] < best[0] else best
        now, n = numpy_step(every, best[3], best[1], quality_rules.SUPPORT), 1
        while True:
            after, n = numpy_step(every, now[3], now[1], quality_rules.SUPPORT), n + 1
            if after[0] >= now[0] - quality_rules.FALL:
                break
            now = after
        steps.append(n)
        one = found[g]
        assert one.logdet == pytest.approx(now[0], abs=1e-9)
        assert np.allclose([one[f"m_{i}"] for i in range(5)], now[1], rtol=0, atol=1e-9)
        assert np.allclose([one[f"c_{i}_{j}"] for i, j in quality_rules._LOW], [now[2][i, j] for i, j in quality_rules._LOW], rtol=0, atol=1e-9)
    assert start_steps or len(set(steps)) > 1  # groups settle at their own time


def test_estimates_do_not_depend_on_partitions(spark, clouds, monkeypatch):
    def result(df):
        return sorted(map(tuple, quality_rules.quality_rules(df).collect()))

    one = result(clouds.coalesce(1))
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)  # as with very many groups
    assert result(clouds.repartition(7)) == one


def test_small_groups_lean(spark, clouds):
    """A group of one document and one of few are judged by the wider ones, the more so the smaller they are."""
    some = clouds.where("doc_id < 3").selectExpr("doc_id + 5000 as doc_id", "text", "lang", "'few' as source")
    far = clouds.where("doc_id = 1000").selectExpr("doc_id + 7000 as doc_id", "text", "lang", "'one' as source")
    other = clouds.where("doc_id = 7").selectExpr("doc_id + 9000 as doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(clouds.union(some).union(far).union(other)).collect()}
    assert all(rows[5000 + i].kept and rows[5000 + i].distance2 < 20 for i in range(3)) and rows[9007].kept
    assert not rows[8000].kept and rows[8000].distance2 < rows[1000].distance2
    strict = {r.doc_id: r.distance2 for r in quality_rules.quality_rules(clouds.union(far), lean=1_000_000).collect()}
    assert strict[8000] > rows[8000].distance2


def test_keep_good_goes_by_rows(spark, clouds):
    good, bad = (clouds.where(f"doc_id = {i}").first().text for i in (0, 1000))
    docs = clouds.union(spark.createDataFrame([(7000, good, "en", "s"), (7000, bad, "en", "s"), (7000, None, "en", "s"), (None, good, None, None)], clouds.schema)).selectExpr("*", "1 as _kept", "'x' as distance2", "2 as Grp")
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert [r.text for r in rows if r.doc_id == 7000] == [good] and [r.text for r in rows if r.doc_id is None] == [good]
    assert not [r for r in rows if r.doc_id and 1000 <= r.doc_id < 1006] and {(r._kept, r.distance2, r.Grp) for r in rows} == {(1, "x", 2)}


def test_rules_of_odd_rows(odd, nothing):
    got = quality_rules.quality_rules(odd.withColumn("grp", F.lit(1)).withColumn("m_0", F.lit(2))).collect()
    assert len(got) == odd.count()
    assert all(not r.kept for r in got if r.n_words < 50) and not [r for r in got if r.doc_id == 4][0].kept
    assert quality_rules.quality_rules(nothing).count() == 0


def test_rules_run_without_python(spark, sf_dir):
    plan = queries()["op4_quality_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rules_tell_good_from_bad(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries()["op4_quality_rules"](spark, sf_dir).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4


# classifier


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries()["op2_quality_classifier"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (quality_model.crc_mod5(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = np.array([s for s, y in out if y]), np.array([s for s, y in out if not y])
    auc = ((good[:, None] > bad[None]) + 0.5 * (good[:, None] == bad[None])).mean()
    assert auc > 0.95


def test_classifier_of_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.fit(quality_model.fit_sample(odd, none))
    assert {r.score for r in quality_model.score(odd.withColumn("score", F.lit("clash")), model).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (None, 0), (9, 0), (4, 5), (2, None), (8, 1), (3, 0)], "doc_id long, quality int")
    model = quality_model.fit(quality_model.fit_sample(odd, labels))
    scores = [r.score for r in quality_model.score(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert quality_model.score(nothing, model).count() == 0
    assert len(quality_model.fit_sample(odd, labels, fit_rows=2)) <= 2


def test_long_texts_are_passed_over(spark):
    ids = [i for i in range(60) if quality_model.crc_mod5(i)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, f"text {i:02d}") for i in ids], "doc_id long, text string")
    order = [int(t[5:7]) for t, _ in quality_model.fit_sample(docs, labels)]
    assert sorted(order) == ids
    # the first, a middle one and the last in hash order do not fit; one id has a long and a short text
    long = {order[0], order[9], order[-1]}
    odd = docs.where(~F.col("doc_id").isin(*long)).union(docs.where(F.col("doc_id").isin(*long)).select("doc_id", F.repeat("text", F.lit(1000))))
    rest = [i for i in order if i not in long]
    assert quality_model.fit_sample(odd, labels, fit_bytes=2000) == [(f"text {i:02d}", i % 2) for i in rest]
    both = odd.union(docs.where(F.col("doc_id") == order[0]))
    assert quality_model.fit_sample(both, labels, fit_bytes=2000) == [(f"text {i:02d}", i % 2) for i in [order[0], *rest]]
    # repeated rows count each
    assert quality_model.fit_sample(docs.union(docs), labels, fit_bytes=7 * 3) == [(f"text {i:02d}", i % 2) for i in (order[0], order[0], order[1])]


def test_pooling_equals_plain_means():
    texts = pa.array(["a b a", "", "b c", None, "zz"], pa.string())
    word, shape, per_doc = next(quality_model.terms(texts))
    v = quality_model.Vectors.learn(word, per_doc, most=3)
    got = v.pooled(word, per_doc)
    at = 0
    assert len(v.codes) == 3 < len(set(word.tolist()))
    for row, n in zip(got, per_doc.tolist(), strict=True):
        mine = word[at : at + n]
        every = [v.vectors[np.flatnonzero(v.codes == c)[0]] if c in v.codes else quality_model.index_vectors(np.array([c]))[0] / 2 for c in mine]
        assert np.allclose(row[:-1], np.mean(every, axis=0) if every else 0, atol=1e-6)
        assert row[-1] == pytest.approx(np.isin(mine, v.codes).mean() if n else 0)
        at += n


def test_one_task_fits_what_the_driver_would(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a, b = quality_model.fitted(docs, labels, fit_rows=60), quality_model.fit(quality_model.fit_sample(docs, labels, fit_rows=60))
    texts = pa.array([r.text for r in docs.limit(50).collect()], pa.string())
    assert np.array_equal(a.scores(texts), b.scores(texts))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.fitted(docs, none).share == 0.5


# pages

PAGES = {
    "<article><h1>T</h1><p>One  <b>bo</b>ld&amp;<br>two.</p><div class=comments><p>I liked this one.</p></div></article><footer>&copy; x</footer>": "T One bold& two.",
    "<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='post-content'><p>First sentence here. Another sentence.</p><div class='ad'>Buy now.</div><p>Last sentence here.</p></div><aside><p>See also this.</p></aside>": "First sentence here. Another sentence. Last sentence here.",
    "<body><div class=cookie-notice>We use cookies. Please accept.</div><main><p>Text of the page. It goes on.</p></main><form><label>Mail</label><button>Go</button></form></body>": "Text of the page. It goes on.",
    "<article><p>Cut off in the mid": "Cut off in the mid",
    "<article><p>a</p><script>var x='<p>no</p>'</script><!-- <p>no</p> --><p>b</p>": "a b",
    "": "",
    "<article><h1>T</h1><p>Words of the page. <svg><g><text>Icon label</text></g></svg> More words here.</p><p>Last words of it.</p></article>": "T Words of the page. More words here. Last words of it.",
    "<article><h1>T</h1><p>Some words here, a<svg><path d='M0'/><g/><p>no</p></svg>b.</p><canvas><div>no</div></canvas><p>Last words of it.</p></article>": "T Some words here, ab. Last words of it.",
    "<article><h1>T</h1><p>First words of it. <object><table><tr><td>no</table></object><math><mfrac><li>no</mfrac></math></p><p>Last words of it.</p></article>": "T First words of it. Last words of it.",
    "<article><h1>T</h1><p>First words of it.</p><noscript><p>Words for readers who run no scripts. They go on for a while.</p></noscript><p>Last words of it.</p></article>": "T First words of it. Words for readers who run no scripts. They go on for a while. Last words of it.",
    "<html><head><title>t</title><noscript><link href=x></noscript><article><h1>T</h1><p>No head was ended here. It goes on.</p></article>": "T No head was ended here. It goes on.",
    "<article><h1>T</h1><p>First words of it.</p><iframe src=x><p>Middle words of it.</p><template><p>no</p></article><footer>&copy; x</footer>": "T First words of it. Middle words of it.",
    "<article><h1>T</h1><p>First words of it.</p><title>x<textarea><p>Last words of it.</p></article>": "T First words of it. x Last words of it.",
    "<article><h1>T</h1><p>First words of it.</p><script>var x = '<p>no</p>'": "T First words of it.",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_extract.main_text(page, html_extract.trained()) == PAGES[page]


def test_extraction_of_pages(spark, sf_dir, nothing):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = html_extract.extract(pages.withColumn("text", F.lit(1))).collect()
    assert len(rows) == pages.count()
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"<[^>]*>", "", s) for s in re.split(r"</?(?:p|br|h1|ul|li)>", body)]
        assert r.text == " ".join(" ".join(html.unescape(s) for s in parts).split()) and r.n_chars == len(r.text)
    odd_pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "<p"), (3, "u", "<" * 1000), (4, "u", "x" * 300_000)], "page_id long, url string, html string")
    assert html_extract.extract(odd_pages).count() == 5
    assert html_extract.extract(odd_pages.limit(0)).count() == 0


@pytest.mark.parametrize("plain", [None, True, False])
def test_field_on_held_out_pages(plain):
    """Also where nothing but tags says what a part is."""
    field = html_extract.trained()
    right = total = 0
    for features, labels in html_extract.training_pages(20_000, 150, plain):
        right += sum(a == b for a, b in zip(field.decode(features), labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


BODY = "<p>Some text of the article that goes on for a while, as such texts do. It has a second sentence, too.</p>" * 3
OTHER_LAYOUTS = {
    "menu before, no article": f"<html><body><div class='c2'><a href='/'>Link</a> <a href='/o'>Other</a></div><div class='c1'><h1>Title</h1>{BODY}</div></body></html>",
    "menu after, no article": f"<html><body><div class='c1'><h1>Title</h1>{BODY}</div><div class='c2'><ul><li><a href='/'>Link</a><li><a href='/o'>Other</a></ul></div></body></html>",
    "notice": f"<html><body><article><h1>Title</h1>{BODY}</article><div class='cc'><p>We use cookies to improve your visit. Accept all.</p></div></body></html>",
    "controls": f"<html><body><article><h1>Title</h1>{BODY}<select><option>One<option>Two</select>{BODY}<button>Share</button></article></body></html>",
}


@pytest.mark.parametrize("name", OTHER_LAYOUTS)
def test_layouts_without_hints(name):
    page = OTHER_LAYOUTS[name]
    body = " ".join(re.findall("<p>(Some.*?)</p>", page))
    assert html_extract.main_text(page, html_extract.trained()) == f"Title {body}"


def test_viterbi_and_sums_equal_brute_force():
    from itertools import product
    from math import exp, log

    r = random.Random(2)
    field = html_extract.Field({f: r.gauss(0, 1) for f in "abcd"}, [[0.3, -0.5], [0.1, 0.8]], [0.2, -0.1])
    rows = [[r.choice("abcd")] for _ in range(5)]
    score = field.emissions(rows)
    value = {y: field.first[y[0]] + sum(s for s, k in zip(score, y, strict=True) if k) + sum(field.pairs[a][b] for a, b in zip(y, y[1:], strict=False)) for y in product((0, 1), repeat=5)}
    assert tuple(field.decode(rows)) == max(value, key=value.get)
    total = log(sum(map(exp, value.values())))
    one, two = field.marginals(rows)
    assert one == pytest.approx([sum(exp(v - total) for y, v in value.items() if y[i]) for i in range(5)])
    assert two[2][1][0] == pytest.approx(sum(exp(v - total) for y, v in value.items() if y[2] == 1 and y[3] == 0))


def test_deep_and_broken_markup_takes_linear_time():
    for page in ("<div>" * 50_000, "</div>" * 50_000, "<a '" * 50_000, '<a "' * 50_000 + ">", "<!--" * 50_000, "<p><b>" * 30_000 + "x", "&" * 100_000, "<li>" * 50_000, "<iframe><title>" * 50_000, "<svg><p>" * 50_000, "<p><svg></p>" * 50_000, "<noscript>" * 50_000):
        html_blocks.blocks(page)


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, before = docs, docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, before, sf)
        kept.write.parquet(f"file://{tmp_path}/{name}")
        kept = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "tokens":
            assert kept.columns == docs.columns
        if name == "near_duplicates":
            groups = brute_components([(r.doc_id, r.text) for r in before.collect()], jaccard.Rule())
            assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in groups})
        if name in ("personal_data", "tokens"):
            assert kept.count() == before.count()
        before = kept
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    quality = spark.read.parquet(f"file://{tmp_path}/quality").join(labels, "doc_id").groupBy("quality").count().collect()
    counts = {r.quality: r["count"] for r in quality}
    assert counts[1] >= 0.98 * labels.where("quality = 1").count() and counts.get(0, 0) <= 0.1 * labels.where("quality = 0").count()
    assert kept.where("not exact").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == kept.count()


def test_columns_of_any_name_stay(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _gone", "'x' as `group`", "2 as Mark", "3 as `first.id`", "4 as _id", "5 as is_first")
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (2, b)]
    assert {tuple(r)[2:] for r in kept.collect()} == {(1, "x", 2, 3, 4, 5)}
    lone = spark.createDataFrame([(3, b), (3, b)], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.drop_near_duplicates(lone).collect()] == [(3, b)]


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(5, a), (5, b), (3, b + " near"), (7, c), (7, c), (8, c + " near"), (None, c), (None, d), (None, d), (None, d + " near"), (9, None), (9, None), (None, ""), (5, a)]
    docs = spark.createDataFrame([(i, t, f"s{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    rest = [x for x in got if x[1]]
    assert sorted((x for x in rest if x[0]), key=str) == [(3, b + " near"), (5, a), (7, c)]
    assert len([x for x in rest if x[0] is None]) == 1 and rest[[x[0] for x in rest].index(None)][1] in (d, d + " near")
    assert sorted((x for x in got if not x[1]), key=str) == [(9, None), (9, None), (None, "")]


EXTRA = {"_score": "1.5", "n_words": "777", "Hit_Spans": "'mine'", "pii_spans": "2", "_gone": "'x'", "mark": "3", "a.b": "4", "cls": "5", "key": "6"}


def test_stages_take_odd_rows(spark, odd, nothing):
    """Each stage's rows, with columns of clashing names, against what is worked out row by row."""
    import corpus_pipeline
    import sentencepiece
    from test_text_operators import brute_hits

    sf = "/root/testdata/sf0.001"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = odd.selectExpr("*", *[f"{v} as `{k}`" for k, v in EXTRA.items()])
    rows = docs.collect()
    texts = [r.text for r in rows]
    model = quality_model.fitted(read("documents"), read("labels"))
    benchmark = [(r.item_id, r.text) for r in read("benchmark").collect()]
    copies = {r: n for n, r in enumerate(rows)}  # of equal rows one
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.piece_model())
    redacted = lambda t: "mail <EMAIL> or <PHONE> " * 3 if t and "@" in t else t
    want = {
        "quality": [r for r, s in zip(rows, model.scores(pa.array(texts, pa.string())), strict=True) if s >= 0.3],
        # rows 1 and 5 share a text: the smaller id stays
        "near_duplicates": [r for n, r in enumerate(rows) if r.doc_id != 5 and (not (r.text or "").split() or copies[r] == n)],
        "decontamination": [r for r in rows if not (r.text and brute_hits(r.text, benchmark)[1])] if len(benchmark) < 500 else None,
        "personal_data": [(r.doc_id, redacted(r.text), r.lang, r.source, r.n_chars if r.text is None else len(redacted(r.text)), *r[5:]) for r in rows],
        "tokens": [(*r[:6], *r[7:], library.encode(r.text or ""), len(library.encode(r.text or "")), library.decode(library.encode(r.text or "")) == (r.text or "")) for r in rows],
    }
    for name, stage in stages.items():
        out = stage(spark, docs, sf)
        assert out.columns == (docs.columns if name != "tokens" else [*docs.columns, "token_ids", "n_tokens", "exact"])
        if name == "tokens":
            want[name] = [(*r, *w[-3:]) for r, w in zip(rows, want[name], strict=True)]
        if want[name] is not None:
            assert sorted(repr(tuple(r)) for r in out.collect()) == sorted(repr(tuple(r)) for r in want[name]), name
        assert stage(spark, nothing, sf).collect() == []
