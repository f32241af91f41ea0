"""Quality rules: per-text statistics, fixed base rules, and robust multivariate outliers, in DataFrame functions only.

Each language and source gets a minimum-covariance-determinant estimate of where its documents' transformed
statistics lie, and so do each language and all documents together, on which small groups lean. An estimate is found
from several starts: `starts` small sets of documents chosen by a hash, and all documents. Concentration steps follow -
keep the share `support` of documents nearest by Mahalanobis distance, take their mean and covariance, repeat; first a
few on a hash-chosen part of about `start_rows` documents of each group, then from the start of the smallest
determinant on all documents, until no group's determinant falls any more; the smallest stands. It is scaled to what a
normal cloud would show, and reweighted once: mean and covariance of the documents within the 97.5 % quantile.
Statistics that hardly vary in a group (no symbols at all, say) would make every determinant 0, so a fixed floor is
added to the covariance's diagonal throughout (a regularised determinant). A group's estimate is drawn to its
language's, and that one to all documents', by the weight of `lean` documents, so groups of every size are judged by
one rule. A document whose squared distance is above the `quantile` of the chi-square distribution is rejected.

Everything is the same for any order of rows and any partitioning: statistics become whole numbers of 1/1024, sums are
sums of whole numbers (exact up to 2^35 documents of a group), and the nearest share is cut at the edge of a fine fixed
bin of distances, all of whose documents count.

The text is read once, without a shuffle; what goes on is a thin table of numbers in the shared folder. Every step is
a pre-aggregated group-by, so a source that holds a third of all rows is no hot key. The estimates, a row a group,
meet the rows in a broadcast join up to BROADCAST_GROUPS groups (8 MB), and beyond that in a join salted by the rows.

Defined cases: a null or empty text has no words and fails the base rules; documents that fail these take no part
in the estimates; a null language or source is a value like any other; a group of one document is judged by what
it leans on; repeated rows count each, and rows of one id are judged one by one; a very long text is taken whole; an
empty table gives an empty result; other columns are kept out of quality_rules and stay as they are in keep_good.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, own

WHITE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
WINDOW = 3
#: Share of a group that the estimate rests on; chi-square quantile beyond which a document goes; quantile for reweighting.
SUPPORT, QUANTILE, WEIGHTED = 0.75, 1 - 1e-6, 0.975
#: Random starts, documents of a group that they are compared on, and steps there.
STARTS, START_ROWS, START_STEPS = 5, 2000, 3
#: A step that lowers a log determinant by less leaves a group as it is.
FALL = 1e-9
#: Documents of the wider group that a group's own estimate is mixed with.
LEAN = 40
#: Added to the variance of each transformed statistic.
FLOORS = {"x_length": 0.005, "x_symbols": 0.1, "x_upper": 0.02, "x_repeats": 0.4, "x_lines": 0.4}
FEATURES = list(FLOORS)
#: Whole numbers in one unit of a statistic; bins in a doubling of the distance.
UNIT, BINS = 1024, 64
BROADCAST_GROUPS, SALTS, FILE_GROUPS = 20_000, 64, 20_000
_P = range(len(FEATURES))
_LOW = [(i, j) for i in _P for j in range(i + 1)]


def chi_square(x: float, freedom: int) -> float:
    """The chi-square distribution's cumulative probability, by the series of the incomplete gamma function."""
    a, h = freedom / 2, x / 2
    term = total = 1 / a
    k = a
    while term > 1e-17 * total:
        k += 1
        term *= h / k
        total += term
    return total * math.exp(a * math.log(h) - h - math.lgamma(a)) if x > 0 else 0.0


@lru_cache(maxsize=16)
def chi_square_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < share else (low, middle)
    return high


def widening(share: float) -> float:
    """How much narrower the nearest share of a normal cloud is than the cloud, as a factor that widens its covariance back."""
    return share / chi_square(chi_square_quantile(share, len(FEATURES)), len(FEATURES) + 2)


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, mark, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper); mark: a hash of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(" \t\n\x0b\f\r"))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{WHITE}+", -1)).alias("w"),
        F.when(F.contains(body, F.lit("\n")), lines).alias("lines"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    n = F.size("w")
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))
    step = step.select(
        "doc_id", "mark", "lang", "source", "n_symbols", "n_upper",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.when(F.col("lines").isNotNull(), F.size("lines")).otherwise((n > 0).cast("int")).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, hashes).alias("h"),
    )
    # only where a window comes again are windows sorted by hash: one that repeats stands beside its like
    again = F.size("h") > F.size(F.array_distinct("h"))
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.withColumn("g", F.when(again, placed)).drop("h")
    twice = F.filter(
        F.transform("g", lambda x, k: F.when((x["h"] == F.get("g", k - 1)["h"]) | (x["h"] == F.get("g", k + 1)["h"]), x["i"])),
        lambda x: x.isNotNull(),
    )
    step = step.withColumn("p", F.when(F.col("g").isNotNull(), F.sort_array(twice))).drop("g")
    gaps = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.least(F.lit(WINDOW), F.get("p", k) - F.get("p", k - 1)))
    covered = F.when(F.size("p") > 1, F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x)).otherwise(0)
    return step.withColumn("n_repeat_words", covered.cast("long")).drop("p")


def base_rules(stats: DataFrame) -> DataFrame:
    """statistics with base_failed: too few words, or more than half of them in windows that come again."""
    return stats.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    share = lambda x, of: F.log1p(100.0 * F.col(x) / of)
    return {
        "x_length": F.log((F.col("word_chars") + 1.0) / n),
        "x_symbols": share("n_symbols", n),
        "x_upper": share("n_upper", F.greatest(F.col("word_chars"), F.lit(1)).cast("double")),
        "x_repeats": share("n_repeat_words", n),
        "x_lines": share("n_dup_lines", lines),
    }


def _keys() -> list[Column]:
    """Names of the groups of a document, from all documents to its language and source."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return [F.lit("*"), F.to_json(F.array(part("lang"))), F.to_json(F.array(part("lang"), part("source")))]


def _met(rows: DataFrame, table: DataFrame, groups: int) -> DataFrame:
    """rows joined to a table of one row or some for each group."""
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(table), "grp")  # 20,000 groups of some 400 bytes
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id", *FEATURES), F.lit(SALTS)).cast("int")).join(salted, ["grp", "_salt"]).drop("_salt")


def _small(table: DataFrame, groups: int) -> DataFrame:
    """A table of a row a group, written in few files."""
    return materialize(table.coalesce(max(1, groups // FILE_GROUPS)))


def _whitened(group: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m_i, c_i_j, logdet, and the rows w_i_j of the inverse of the covariance's Cholesky factor): each name is used by those after it."""
    keep = [*keys, *[f"m_{i}" for i in _P], *[f"c_{i}_{j}" for i, j in _LOW]]
    low, inverse = [], []
    for i, j in _LOW:
        rest = "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
        low.append(f"sqrt(greatest(c_{i}_{j}{rest}, 1e-9D)) AS l_{i}_{j}" if i == j else f"(c_{i}_{j}{rest}) / l_{j}_{j} AS l_{i}_{j}")
    for i, j in _LOW:
        rest = " + ".join(f"l_{i}_{k} * w_{k}_{j}" for k in range(j, i))
        inverse.append(f"1.0D / l_{i}_{i} AS w_{i}_{j}" if i == j else f"-({rest}) / l_{i}_{i} AS w_{i}_{j}")
    logdet = " + ".join(f"2.0D * ln(l_{i}_{i})" for i in _P)
    return group.selectExpr(*keep, *low, *inverse, f"{logdet} AS logdet").select(*keep, *[f"w_{i}_{j}" for i, j in _LOW], "logdet")


def _distance() -> Column:
    """The squared Mahalanobis distance. As one text, like _moments: built of single columns, they took longer than the steps."""
    z = ["(" + " + ".join(f"w_{i}_{j} * ({FEATURES[j]} / {UNIT} - m_{j})" for j in range(i + 1)) + ")" for i in _P]
    return F.expr(" + ".join(f"{x} * {x}" for x in z))


#: Names of the sums that mean and covariance come from: they add up over any parts of a group.
_SUMS = ["n", *[f"s_{i}" for i in _P], *[f"q_{i}_{j}" for i, j in _LOW]]


def _sums(rows: DataFrame, keys: list[str | Column], *more: Column) -> DataFrame:
    """(keys, n, s_i, q_i_j) of rows: their number, sums and sums of products, all whole numbers. more: other aggregates."""
    sums = [F.expr(f"sum({FEATURES[i]}) AS s_{i}") for i in _P] + [F.expr(f"sum({FEATURES[i]} * {FEATURES[j]}) AS q_{i}_{j}") for i, j in _LOW]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *more)


def _moments(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """(keys, n, m_i, c_i_j) of _sums: mean, and covariance times factor plus floors."""
    # n * q - s * s is a whole number too: nothing is lost before the division
    spread = "CAST(CAST(n AS DECIMAL(18,0)) * CAST(q_{0}_{1} AS DECIMAL(20,0)) - CAST(s_{0} AS DECIMAL(19,0)) * CAST(s_{1} AS DECIMAL(19,0)) AS DOUBLE)"
    floor = lambda i, j: FLOORS[FEATURES[i]] if i == j else 0.0
    return sums.selectExpr(
        *keys, "n", *[f"s_{i} / CAST(n AS DOUBLE) / {UNIT} AS m_{i}" for i in _P],
        *[f"{factor!r}D * {spread.format(i, j)} / CAST(n AS DOUBLE) / CAST(n AS DOUBLE) / {UNIT * UNIT} + {floor(i, j)!r}D AS c_{i}_{j}" for i, j in _LOW],
    )


def _estimates(moments: DataFrame, keys: list[str], groups: int) -> DataFrame:
    return _small(_whitened(moments, keys), groups)


def _concentrated(rows: DataFrame, now: DataFrame, keys: list[str], groups: int, support: float) -> DataFrame:
    """One step for every group (and start) of now: the nearest share gives the next mean and covariance, and `last` is the log determinant before.

    The rows are read once: they become sums by bin of distance, and a group's bins up to the edge add up.
    """
    near = F.floor(BINS * F.log2(1.0 + 1024.0 * _distance())).cast("int")
    bins = _sums(_met(rows, now, groups), [*keys, near.alias("bin")], F.max("logdet").alias("last"))  # a row for each bin
    w = Window.partitionBy(*keys)
    bins = bins.withColumns({"nearer": F.sum("n").over(w.orderBy("bin")) - F.col("n"), "every": F.sum("n").over(w)})
    kept = bins.where(F.col("nearer") < F.ceil(support * F.col("every"))).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS], F.max("last").alias("last"))
    return _small(_whitened(_moments(kept, [*keys, "last"], widening(support)), [*keys, "last"]), groups)


def _best(tables: list[DataFrame], groups: int) -> DataFrame:
    """The estimate of the smallest determinant of each group."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    names = [c for c in every.columns if c not in ("grp", "start", "last")]
    one = every.groupBy("grp").agg(F.min(F.struct("logdet", *[c for c in names if c != "logdet"])).alias("e"))
    return _small(one.select("grp", *[f"e.{c}" for c in names]), groups)


def estimate(rows: DataFrame, support: float = SUPPORT, starts: int = STARTS) -> tuple[DataFrame, int]:
    """((grp, m_i, c_i_j, w_i_j, logdet) of the smallest determinant found for each group, number of groups). rows: (grp, id, statistics in whole numbers)."""
    sizes = materialize(rows.groupBy("grp").agg(F.count("*").alias("size")).coalesce(1))
    groups = sizes.count()
    part, few = _chosen(rows, sizes, groups, starts)
    part = materialize(part)
    keys = ["grp", "start"]
    now = _estimates(_moments(_sums(part.withColumn("start", F.lit(0)).unionByName(few), keys), keys, 1.0), keys, groups * (starts + 1))
    for _ in range(START_STEPS):
        now = _concentrated(part, now, keys, groups * (starts + 1), support)
    # determinants on the part and on all documents are not alike: the first step on all documents starts the comparison
    found = [_concentrated(rows, _best([now], groups), ["grp"], groups, support)]
    falling = found[0]
    while not falling.isEmpty():
        # groups that have settled drop out; a determinant has a floor and falls by FALL at least, so this ends
        found.append(_concentrated(rows, falling, ["grp"], groups, support))
        falling = found[-1].where(F.col("logdet") < F.col("last") - FALL)
    return _best(found, groups), groups


def _chosen(rows: DataFrame, sizes: DataFrame, groups: int, starts: int) -> tuple[DataFrame, DataFrame]:
    """(the part of each group that starts are compared on, the documents of each start), chosen by hashes."""
    chance = lambda seed, wanted: F.pmod(F.xxhash64(F.lit(seed), "id", *FEATURES), F.lit(1 << 40)) / float(1 << 40) < float(wanted) / F.col("size")
    sized = _met(rows, sizes, groups)
    part = sized.where(chance(0, START_ROWS)).select(*rows.columns)
    # each start: about twice as many documents as a covariance needs; start 0: all of the part
    few = sized.select(*rows.columns, F.explode(F.array(*[F.when(chance(k, 2 * (len(FEATURES) + 1)), F.lit(k)) for k in range(1, starts + 1)])).alias("start")).where("start is not null")
    return part, few


def _leaning(levels: DataFrame, lean: int, groups: int) -> DataFrame:
    """The whitened estimates of each language and source, mixed with its language's, and that one's with all documents'."""
    names = ["n", *[f"m_{i}" for i in _P], *[f"c_{i}_{j}" for i, j in _LOW]]
    level = lambda k, to: levels.where(F.col("level") == k).select("grp", "up", *[F.col(c).alias(f"{to}_{c}") for c in names])

    def mixed(own_one: DataFrame, up: DataFrame) -> DataFrame:
        share = F.col("a_n") / (F.col("a_n") + float(lean))
        met = own_one.join(up.select(F.col("grp").alias("up"), *[c for c in up.columns if c.startswith("b_")]), "up")
        return met.select("grp", "up", "a_n", *[(share * F.col(f"a_{c}") + (1.0 - share) * F.col(f"b_{c}")).alias(c) for c in names[1:]])

    langs = mixed(level(1, "a"), level(0, "b")).select("grp", *[F.col(c).alias(f"b_{c}") for c in names[1:]])
    return _estimates(mixed(level(2, "a"), langs).select("grp", *names[1:]), ["grp"], groups)


def judged(docs: DataFrame, *, doc_id: str, text: str, lang: str, source: str, support: float, quantile: float, lean: int) -> DataFrame:
    """statistics of every row with base_failed, distance2 and kept."""
    stats = base_rules(statistics(docs, doc_id=doc_id, text=text, lang=lang, source=source))
    whole = [F.round(c * UNIT).cast("long").alias(k) for k, c in _features().items()]
    stats = materialize(stats.select("*", _keys()[2].alias("grp"), *whole))
    keys = _keys()
    ways = F.array(*[F.struct(k.alias("grp"), (keys[i - 1] if i else F.lit("")).alias("up"), F.lit(i).alias("level")) for i, k in enumerate(keys)])
    rows = materialize(stats.where("not base_failed").select(F.xxhash64("doc_id", "mark").alias("id"), F.explode(ways).alias("k"), *FEATURES).select("k.*", "id", *FEATURES))
    thin = rows.select("grp", "id", *FEATURES)
    raw, groups = estimate(thin, support)
    # reweighted: documents within the quantile, which are a known share of a normal cloud
    within = _met(thin, raw, groups).where(_distance() <= chi_square_quantile(WEIGHTED, len(FEATURES)))
    levels = _moments(_sums(within, ["grp"]), ["grp"], widening(WEIGHTED)).join(rows.select("grp", "up", "level").distinct(), "grp")
    table = _leaning(materialize(levels.coalesce(max(1, groups // FILE_GROUPS))), lean, groups)
    final = table.select("grp", *[c for c in table.columns if c[:2] in ("m_", "w_")])
    far = F.when(~F.col("base_failed"), _distance())
    scored = _met(stats.withColumn("id", F.xxhash64("doc_id", "mark")), final, groups) if groups > BROADCAST_GROUPS else stats.join(F.broadcast(final), "grp", "left")
    if groups > BROADCAST_GROUPS:  # a group all of whose documents fail has no estimate
        scored = scored.unionByName(stats.join(final, "grp", "left_anti"), allowMissingColumns=True)
    scored = scored.withColumn("distance2", far)
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= chi_square_quantile(quantile, len(FEATURES)), F.lit(True)))


def quality_rules(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    support: float = SUPPORT, quantile: float = QUANTILE, lean: int = LEAN,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2, kept) of every row."""
    rows = judged(docs, doc_id=doc_id, text=text, lang=lang, source=source, support=support, quantile=quantile, lean=lean)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept")


def keep_good(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    support: float = SUPPORT, quantile: float = QUANTILE, lean: int = LEAN,
) -> DataFrame:
    """docs without the rejected rows. Each row goes by its own id, text, language and source, so rows that share an id are judged one by one."""
    rows = judged(docs, doc_id=doc_id, text=text, lang=lang, source=source, support=support, quantile=quantile, lean=lean)
    names = [own(c) for c in ("id", "mark", "lang", "source")]
    kept = rows.where("kept").select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "mark", "lang", "source"), names, strict=True)]).distinct()
    mine = [docs[doc_id], F.xxhash64(docs[text]), docs[lang], docs[source]]
    same = mine[0].eqNullSafe(kept[names[0]])
    for a, n in zip(mine[1:], names[1:], strict=True):
        same = same & a.eqNullSafe(kept[n])
    return docs.join(kept, same, "left_semi")
