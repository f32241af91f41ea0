"""Registered queries: each operator over whole tables, with fixed parameters, arrays laid out as rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import fiscal, names, numbers
from tallyloom.operators import bulk, links, matching, reconcile, search, series, summary, trend
from tallyloom.sources import csv_files, facts, links_store, postings, scratch
from tallyloom.sources.tables import Inputs, bought_lines, dealt, dispensed_lines, from_star, tasks_for
from tallyloom.streaming import monthly

YEAR, TERM, WILD, TOP = 1998, "ring", "r_ng sm%", 10
#: Pasted text of a bulk import: headers, blanks, quotes, a short record, conflicts and repeats.
CSV = """icode,working_code,drug_name_hosxp,drug_name_invs
1,1,small ring 5 mg,
2,9,"red, widget",x

5,77,new item,new name
5,78,again,

,4,blank code,
3
10,10,excluded no more,ok
1,1,later name,
"""


def _inputs(query: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(from_star(spark, sf_dir))


#: Folders of an index that is made for one search.
INDEX_BLOCKS = 16


def h_search_indexed(x: Inputs) -> DataFrame:
    path = scratch.folder(x.items.sparkSession, "postings")
    postings.write(x.items, path, "icode", "name", INDEX_BLOCKS)
    return search.search_items(postings.Postings(x.items.sparkSession, path, INDEX_BLOCKS).rows(TERM), TERM)


def _catalog_index(x: Inputs) -> postings.Postings:
    path = scratch.folder(x.catalog.sparkSession, "postings")
    postings.write(x.catalog, path, "working_code", "drug_name", INDEX_BLOCKS)
    return postings.Postings(x.catalog.sparkSession, path, INDEX_BLOCKS)


def i_search_indexed(x: Inputs) -> DataFrame:
    return search.search_catalog(_catalog_index(x).rows(TERM), TERM)


def i_search_wildcard_indexed(x: Inputs) -> DataFrame:
    return search.search_catalog(_catalog_index(x).rows(WILD, wildcards=True), WILD, wildcards=True)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of a table's files. As a pattern the path may be a folder or a single file."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")


def h_monthly_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year's vectors from a table that a stream of the records has kept."""
    source = _stream(spark, sf_dir, "lineitem")
    x, path = from_star(spark, sf_dir), scratch.folder(spark, "months")
    table = monthly.MonthTable(spark, f"{path}/table", monthly.DISPENSED)
    table.keep(dispensed_lines(source), f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _spread(series.item_vectors(table.read(YEAR), x.items), ["icode", "name", "total"], "monthly_qty")


def i_monthly_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year's vectors of what was bought: a stream of lines meets the invoices before it enters the table."""
    source = _stream(spark, sf_dir, "lineitem")
    x, path = from_star(spark, sf_dir), scratch.folder(spark, "months")
    table = monthly.MonthTable(spark, f"{path}/table", monthly.PURCHASED)
    records = bought_lines(source).join(x.headers.select("invoice_no", "receive_date"), "invoice_no")
    table.keep(records, f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = series.code_vectors(table.read(YEAR), x.catalog)
    return _spread(rows, ["working_code", "name", "total_qty", "total_value", "peak_fiscal_month"], "monthly_qty", "monthly_value")


#: Lines of a bucket, all years together.
BUCKET_ROWS = 500_000
_LAID_OUT: dict[tuple[str, str], str] = {}


def _laid_out(query: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query on facts laid out by fiscal year; they are written once an application."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x, key = from_star(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
        if key not in _LAID_OUT:
            path = scratch.folder(spark, "facts")
            facts.write(x, path, tasks_for(x.lines, rows=BUCKET_ROWS))
            _LAID_OUT[key] = path
        return query(facts.bind(x, _LAID_OUT[key]))

    return run


def _spread(rows: DataFrame, keys: list[str], *vectors: str) -> DataFrame:
    flat = rows.select(*keys, F.posexplode(F.arrays_zip(*vectors)).alias("month_idx", "m"))
    return flat.select(*keys, "month_idx", *[f"m.{v}" for v in vectors])


def h_monthly(x: Inputs) -> DataFrame:
    return _spread(series.dispensed_vectors(x.dispense, x.items, YEAR), ["icode", "name", "total"], "monthly_qty")


def i_monthly(x: Inputs) -> DataFrame:
    rows = series.purchased_vectors(x.headers, x.lines, x.catalog, YEAR)
    return _spread(rows, ["working_code", "name", "total_qty", "total_value", "peak_fiscal_month"], "monthly_qty", "monthly_value")


def h_item_monthly(x: Inputs) -> DataFrame:
    return _spread(series.dispensed_vectors(x.dispense, x.items, YEAR, "7"), ["icode", "name", "total"], "monthly_qty")


def i_item_monthly(x: Inputs) -> DataFrame:
    rows = series.purchased_vectors(x.headers, x.lines, x.catalog, YEAR, "7")
    return _spread(rows, ["working_code", "name", "total_qty", "total_value", "peak_fiscal_month"], "monthly_qty", "monthly_value")


def _by_item(x: Inputs) -> Inputs:
    """x with items, links and exclusions dealt by item, into tasks by their rows: joins and windows by item stay there."""
    tasks = tasks_for(x.items, x.links, x.exclusions)
    return replace(x, **{name: getattr(x, name).repartition(tasks, "icode") for name in ("items", "links", "exclusions")})


def mapping_stats(x: Inputs) -> DataFrame:
    one = links.stats(x.links, x.exclusions)
    return one.select("total", "exclusions", *[F.coalesce(F.try_element_at("by_method", F.lit(m)), F.lit(0)).alias(f"n_{m}") for m in links.METHODS])


def _catalog_changes(x: Inputs) -> DataFrame:
    """Every catalog row as a link of the item of the same code, scored by the length of its name."""
    return x.catalog.select(
        F.col("working_code").cast("long").alias("seq"), F.col("working_code").alias("icode"), F.concat(F.lit(" W"), "working_code").alias("working_code"), F.lit("").alias("dispensed_name"),
        F.col("drug_name").alias("purchased_name"), F.lit("manual").alias("match_method"), (F.char_length("drug_name") / 18.0).alias("match_score"),
    )


def mapping_upsert(x: Inputs) -> DataFrame:
    x = _by_item(x)
    after, out, _ = links.set_links(x.links, x.exclusions, _catalog_changes(x))
    return links.status_by_icode(x.items.select("icode"), after, out).select("icode", "status", "working_code", "match_method", "reason")


def mapping_stored(x: Inputs) -> DataFrame:
    """As mapping_upsert, through the store: links and exclusions are saved, changed as a new version, and read from the newest."""
    spark = x.items.sparkSession
    path = scratch.folder(spark, "store")
    links_store.save(spark, path, x.links, x.exclusions)
    links_store.change(spark, path, lambda *now: links.set_links(*now, _catalog_changes(x))[:2])
    now = links_store.snapshot(spark, path)
    return links.status_by_icode(x.items.select("icode"), now.links, now.exclusions).select("icode", "status", "working_code", "match_method", "reason")


def _odd_changes(x: Inputs) -> DataFrame:
    """Of every catalog row two links that keep the rules, the first with white space around its codes, and one that breaks each rule."""
    code, none = F.col("working_code"), F.lit(None)
    made = [  # kind, icode, working_code, method, score
        ("spaces", F.concat(F.lit("\u00a0 "), code, F.lit("\t")), F.concat(F.lit("\u3000W"), code), F.lit("manual"), F.lit(0.5)),
        ("no code", F.lit(" \u3000"), code, F.lit("manual"), F.lit(0.5)), ("null code", none.cast("string"), code, F.lit("manual"), F.lit(0.5)),
        ("no other code", code, F.lit("\t\n"), F.lit("approved"), none.cast("double")), ("unknown method", code, code, F.concat(F.lit("by "), "drug_name"), F.lit(1.0)),
        ("no method", code, code, none.cast("string"), F.lit(1.0)), ("no number", code, code, F.lit("auto"), F.lit(float("nan"))),
        ("above", code, code, F.lit("auto"), 1.0 + code.cast("double") / 1e6), ("below", code, code, F.lit("auto"), -code.cast("double")), ("last", code, F.concat(F.lit("V"), code), F.lit("auto"), F.lit(1.0)),
    ]
    rows = [F.struct(F.lit(k).alias("dispensed_name"), a.alias("icode"), b.alias("working_code"), m.alias("match_method"), s.alias("match_score")) for k, a, b, m, s in made]
    flat = x.catalog.select("drug_name", code.cast("long").alias("k"), F.posexplode(F.array(*rows)).alias("n", "r"))
    return flat.select((F.col("k") * 10 + F.col("n")).alias("seq"), "r.icode", "r.working_code", "r.dispensed_name", F.col("drug_name").alias("purchased_name"), "r.match_method", "r.match_score")


def mapping_rejected(x: Inputs) -> DataFrame:
    bad = links.set_links(x.links, x.exclusions, _odd_changes(x))[2]
    return bad.select(F.col("dispensed_name").alias("kind"), F.trim("icode").alias("icode"), F.col("purchased_name").alias("name"), F.nanvl("match_score", F.lit(-99.0)).alias("match_score"))


def mapping_checked(x: Inputs) -> DataFrame:
    """Of links that keep the rules the last one of a code stands; those that break them change nothing."""
    x = _by_item(x)
    after, out, _ = links.set_links(x.links, x.exclusions, _odd_changes(x))
    return links.status_by_icode(x.items.select("icode"), after, out).select("icode", "status", "working_code", "match_method", "reason")


def mapping_exclude(x: Inputs) -> DataFrame:
    """Every item without a link that a person has set is marked: linked, excluded and open ones."""
    x = _by_item(x)
    now = links.status_by_icode(x.items, x.links, x.exclusions)
    marks = now.where("match_method is null or match_method = 'auto'").select("icode", F.concat(F.lit("mark "), "name").alias("reason"))
    after, out = links.exclude(x.links, x.exclusions, marks)
    return links.status_by_icode(x.items.select("icode"), after, out).select("icode", "status", "working_code", "reason")


_FIGURES = ["year_dispensed", "year_purchased_qty", "year_value", "unit_price_year", "coverage_ratio", "cv_dispensed_qty", "cv_purchased_value", "median_price"]


def reconcile_year(x: Inputs) -> DataFrame:
    out = reconcile.reconcile_links(x)
    return out.select("icode", "working_code", "fy", *[F.round(c, 6).alias(c) for c in _FIGURES], F.size("flags").alias("n_flags"))


def reconcile_month(x: Inputs) -> DataFrame:
    out = reconcile.months(reconcile.reconcile_links(x, YEAR))
    return out.withColumn("price", F.round("price", 6)).withColumn("stock", F.round("stock", 6))


def reconcile_flags(x: Inputs) -> DataFrame:
    return reconcile.flag_rows(reconcile.reconcile_links(x)).drop("flag_no")


def reconcile_flag_texts(x: Inputs) -> DataFrame:
    out = reconcile.flag_texts(reconcile.flag_rows(reconcile.reconcile_links(x, YEAR))).drop("flag_no")
    return out.select("icode", "kind", "month", *[F.round(c, 6).alias(c) for c in ("residue", "overstock_percent", "spike_price")])


def reconcile_headline(x: Inputs) -> DataFrame:
    out = reconcile.headline(reconcile.reconcile_links(x, YEAR))
    return out.withColumns({c: F.round(c, 6) for c in ("unit_price_year", "coverage_ratio")})


def reconcile_item(x: Inputs) -> DataFrame:
    out = reconcile.reconcile_one(x, YEAR, "7")
    return out.select("icode", "working_code", "fy", *[F.round(c, 6).alias(c) for c in _FIGURES], F.size("flags").alias("n_flags"))


def _dispensed_grid(x: Inputs) -> tuple[DataFrame, list[str]]:
    keys = ["icode", "fy"]
    return trend.month_grid(series.dispensed(x.dispense), keys, ["qty"], tasks_for(x.dispense)), keys


def moving_average(x: Inputs) -> DataFrame:
    grid, keys = _dispensed_grid(x)
    return grid.select(*keys, "month_idx", "qty", F.round(trend.moving_average("qty", keys), 6).alias("average"))


def month_share(x: Inputs) -> DataFrame:
    grid, keys = _dispensed_grid(x)
    return grid.select(*keys, "month_idx", "qty", trend.month_share("qty", keys).alias("percent"), fiscal.month_label(F.col("month_idx")).alias("label"))


def stock_curve(x: Inputs) -> DataFrame:
    d = series.dispensed(x.dispense).select(F.col("icode").alias("code"), "fy", "month_idx", (-F.col("qty")).alias("q"))
    p = series.purchased(x.headers, x.lines).select(F.col("working_code").alias("code"), "fy", "month_idx", F.col("qty").alias("q"))
    keys = ["code", "fy"]
    moves = d.unionByName(p).groupBy(*keys, "month_idx").agg(numbers.total(F.col("q")).alias("delta"))
    grid = trend.month_grid(moves, keys, ["delta"], tasks_for(x.dispense, x.lines))
    return grid.select(*keys, "month_idx", "delta", F.round(trend.running_total("delta", keys), 6).alias("stock"))


def default_years(x: Inputs) -> DataFrame:
    """The year that each item shows: the selected one if the item has data for it, else its newest, else the selected one all the same."""
    years = series.dispensed(x.dispense).select("icode", "fy")
    return x.items.select("icode").join(years, "icode", "left").groupBy("icode").agg(fiscal.default_year_of(F.col("fy"), YEAR).alias("fy"))


def years_back(x: Inputs) -> DataFrame:
    """Years with data, and how long ago they were."""
    return summary.merged_years(x.dispense, x.headers).select("fy", (fiscal.current_year() - F.col("fy")).alias("back"))


def months_reordered(x: Inputs) -> DataFrame:
    """Vectors that were summed from January on, brought to fiscal order."""
    d = series.dispensed(x.dispense).withColumn("month", fiscal.calendar_month(F.col("month_idx"))).repartition(tasks_for(x.dispense), "icode", "fy")
    sums = [numbers.total(F.when(F.col("month") == m, F.col("qty")).otherwise(0.0)) for m in range(1, 13)]
    return _spread(d.groupBy("icode", "fy").agg(F.array(*sums).alias("calendar")).withColumn("qty", fiscal.to_fiscal_order(F.col("calendar"))), ["icode", "fy"], "qty")


def terms_escaped(x: Inputs) -> DataFrame:
    """Parts of names that hold the signs of LIKE, escaped, and whether they find the next item's name, which has the same signs."""
    odd = F.translate("name", "aei", "%_~")
    n = x.items.select(F.col("icode").cast("long").alias("k"), odd.alias("odd"), names.escape_like(F.substring(odd, 2, 8)).alias("escaped"))
    other = n.select((F.col("k") - 1).alias("k"), F.col("odd").alias("next"))
    return n.join(other, "k").select("k", "escaped", F.expr("odd LIKE concat('%', escaped, '%') ESCAPE '~'").alias("own"), F.expr("next LIKE concat('%', escaped, '%') ESCAPE '~'").alias("found"))


def names_normalized(x: Inputs) -> DataFrame:
    return x.items.select("icode", names.normalized(F.col("name")).alias("normalized"), names.search_term(F.col("name")).alias("term"))


def similarity_pairs(x: Inputs) -> DataFrame:
    """Each item with the next one by code."""
    n = x.items.select(F.col("icode").cast("long").alias("k"), "name", names.normalized(F.col("name")).alias("norm"))
    m = n.select((F.col("k") - 1).alias("k"), F.col("name").alias("name_b"), F.col("norm").alias("norm_b"))
    return n.join(m, "k").select("k", F.col("name").alias("name_a"), "name_b", F.round(names.similarity_normalized(F.col("norm"), F.col("norm_b")), 6).alias("score"))


def suggest_candidates(x: Inputs) -> DataFrame:
    """The ten best codes of each item, of all that its term finds."""
    out = matching.candidates(x.items.select("icode", F.col("name").alias("drug_name")), x.catalog, TOP, exhaustive=True)
    return out.withColumn("score", F.round("score", 6))


def auto_match_preview(x: Inputs) -> DataFrame:
    page = links.mapping_rows(x.items, x.links, x.exclusions, TERM)
    return matching.auto_match(page, x.catalog, 0.6).withColumn("score", F.round("score", 6))


def auto_match_default(x: Inputs) -> DataFrame:
    """With the score that needs no review, on names that reach it and names that come just below."""
    items, catalog = _near_names(x)
    page = links.mapping_rows(items, x.links, x.exclusions, "x")
    return matching.auto_match(page, catalog).withColumn("score", F.round("score", 6))


#: Words of names that are alike but for one.
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota"


def _near_names(x: Inputs) -> tuple[DataFrame, DataFrame]:
    """(items, catalog): an item's name is a word of its own and 7, 8 or 9 others; most catalog names have one more, so 8 of 9, 9 of 10 or 10 of 11 words are common."""
    k = F.col("icode").cast("long")
    word = F.concat(F.lit("x"), F.translate("icode", "0123456789", "abcdefghij"), F.lit("q"))
    others = F.array_join(F.slice(F.split(F.lit(GREEK), " "), F.lit(1), (7 + k % 3).cast("int")), " ")
    items = x.items.select("icode", F.concat_ws(" ", word, others).alias("name"))
    more = F.when(k % 4 == 0, "").otherwise(" kappa")
    return items, items.select(F.col("icode").alias("working_code"), F.concat("name", more).alias("drug_name"))


def auto_match_apply(x: Inputs) -> DataFrame:
    page = links.mapping_rows(x.items, x.links, x.exclusions, TERM)
    after, out, _ = links.set_links(x.links, x.exclusions, matching.as_changes(matching.auto_match(page, x.catalog, 0.6)))
    return links.status_by_icode(x.items.select("icode"), after, out).select("icode", "status", "working_code", "match_method", "reason")


def names_thai(x: Inputs) -> DataFrame:
    """Each item's name with Thai words, Thai digits and brackets put to it in four ways, and how like the plain name that is."""
    n = F.col("name")
    ways = [
        F.concat(n, F.lit(" (พาราเซตามอล "), "icode", F.lit(" มก.)")),
        F.concat(F.substring(n, 1, 3), F.lit("("), "icode", F.lit("mg)"), F.substring(n, 4, 1000)),
        F.concat(F.lit("บรรจุ ธารา "), n, F.lit(" ๕๐๐ มก. (ยาเม็ด)")),
        F.concat(n, F.lit(" (ตรึม")),
    ]
    rows = dealt(x.items).select("icode", "name", F.posexplode(F.array(*ways)).alias("way", "text"))
    rows = rows.select("icode", "way", names.normalized(n).alias("plain"), names.normalized(F.col("text")).alias("normalized"))
    return rows.select("icode", "way", "normalized", F.round(names.similarity_normalized(F.col("plain"), F.col("normalized")), 6).alias("score"))


def _bulk(x: Inputs, dry_run: bool) -> DataFrame:
    rows, _ = bulk.read(x.items.sparkSession, CSV)
    return bulk.classify(rows, x.links, dry_run).select("line", "physical_line", "icode", "working_code", "outcome", "existing")


def bulk_import_counters(x: Inputs) -> DataFrame:
    rows, errors = bulk.read(x.items.sparkSession, CSV)
    return bulk.counters(bulk.classify(rows, x.links), errors)


def bulk_import_after(x: Inputs) -> DataFrame:
    rows, _ = bulk.read(x.items.sparkSession, CSV)
    after, out = links.upsert(x.links, x.exclusions, bulk.as_changes(bulk.classify(rows, x.links, dry_run=False)))
    return links.status_by_icode(x.items.select("icode"), after, out).select("icode", "status", "working_code", "match_method", "reason")


def similarity_thai(x: Inputs) -> DataFrame:
    """Each item with the next one by code, both as a Thai word: without common tokens, edit distance decides, by characters."""
    spelled = F.translate("icode", "0123456789", "กขคงจฉชซฌญ")
    n = x.items.select(F.col("icode").cast("long").alias("k"), F.concat(F.lit("ยาน"), spelled, F.lit("มฟ")).alias("a"), F.concat(F.lit("ด"), spelled, F.lit("หลู")).alias("b"))
    m = n.select((F.col("k") - 1).alias("k"), F.col("b").alias("name_b"))
    pairs = n.select("k", F.col("a").alias("name_a")).join(m, "k")
    return pairs.select("k", "name_a", "name_b", F.round(names.similarity(F.col("name_a"), F.col("name_b")), 6).alias("score"))


def _csv_folder(x: Inputs) -> str:
    """CSV files of all items by code: rows, headers between them, quotes over two lines, short, blank and incomplete records."""
    path = scratch.folder(x.items.sparkSession, "csv")
    k = F.col("icode").cast("long")
    quoted = F.concat(F.lit('"'), F.replace("name", F.lit("mg"), F.lit('""mg"", or')), F.lit('"'))
    kinds = [
        F.concat_ws(",", "icode", "icode", quoted, F.lit("")), F.concat("icode", F.lit(",W"), "icode", F.lit(',"first\nsecond, of '), "icode", F.lit('",x')), F.col("icode"),
        F.concat(F.lit("  "), "icode", F.lit(" , "), "icode", F.lit(" ")), F.concat(F.lit(","), "icode", F.lit(",no code")), F.concat(F.lit("\n , \n"), "icode", F.lit(","), "icode"),
    ]
    header = F.when(k % 7 == 0, "ICODE,Working_Code,name\n").otherwise("")
    rows = x.items.select(k.alias("k"), F.concat(header, F.get(F.array(*kinds), (k % 6).cast("int"))).alias("value"))
    rows.repartitionByRange(4, "k").sortWithinPartitions("k").select("value").write.text(path)
    return path


def _bulk_files(x: Inputs, dry_run: bool) -> tuple[DataFrame, DataFrame]:
    rows, errors = csv_files.read(x.items.sparkSession, _csv_folder(x))
    return bulk.classify(rows, x.links, dry_run), errors


def bulk_files_classified(x: Inputs) -> DataFrame:
    return _bulk_files(x, True)[0].select("line", "icode", "working_code", "dispensed_name", "outcome", "existing")


def bulk_files_after(x: Inputs) -> DataFrame:
    after, out = links.upsert(x.links, x.exclusions, bulk.as_changes(_bulk_files(x, False)[0]))
    return links.status_by_icode(x.items.select("icode"), after, out).select("icode", "status", "working_code", "match_method", "reason")


def number_texts(x: Inputs) -> DataFrame:
    q = (F.col("qty") / 8).alias("q")
    rows = x.dispense.select("qty").distinct().select("qty", q)
    return rows.select("qty", numbers.quantity_text(F.col("q") * 1000).alias("quantity"), numbers.baht_text(F.col("q") * 100000, 0).alias("baht"), numbers.signed_text(F.col("q") - 3).alias("signed"), F.round(numbers.axis_step(F.col("q")), 6).alias("step"), numbers.axis_label(F.col("qty") * 100).alias("label"))


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    "h_years": lambda x: summary.dispense_years(x.dispense, x.dispense_years),
    "i_years": lambda x: summary.purchase_years(x.headers, x.purchase_years),
    "merged_years": lambda x: summary.merged_years(x.dispense, x.headers, YEAR, (x.dispense_years, x.purchase_years)),
    "h_monthly": h_monthly,
    "i_monthly": i_monthly,
    "h_item_monthly": h_item_monthly,
    "i_item_monthly": i_item_monthly,
    "h_top_drugs": lambda x: summary.top_dispensed(x.dispense, x.items, YEAR, TOP),
    "i_top_drugs": lambda x: summary.top_purchased(x.headers, x.lines, x.catalog, YEAR, TOP),
    "h_year_summary": lambda x: summary.dispense_summary(x.dispense, YEAR),
    "i_year_summary": lambda x: summary.purchase_summary(x.headers, x.lines, YEAR),
    "h_search": lambda x: search.search_items(x.items, TERM),
    "i_search": lambda x: search.search_catalog(x.catalog, TERM),
    "i_search_wildcard": lambda x: search.search_catalog(x.catalog, "r_ng", wildcards=True),
    "h_search_indexed": h_search_indexed,
    "i_search_indexed": i_search_indexed,
    "i_search_wildcard_indexed": i_search_wildcard_indexed,
    "mapping_rows": lambda x: links.mapping_rows(x.items, x.links, x.exclusions, TERM),
    "mapping_rows_unmapped": lambda x: links.mapping_rows(x.items, x.links, x.exclusions, TERM, status="unmapped"),
    "mapping_next_unmapped": lambda x: links.next_unmapped(links.mapping_rows(x.items, x.links, x.exclusions, TERM), ["drug_name", "icode"]).select("icode", "status", "next_icode"),
    "mapping_status_by_icode": lambda x: links.status_by_icode(x.items.select("icode"), x.links, x.exclusions).select("icode", "status", "working_code", "match_method", "reason"),
    "mapping_status_by_code": lambda x: links.status_by_working_code(x.catalog.select("working_code"), x.links).select("working_code", "status", "icode", "match_method"),
    "mapping_stats": mapping_stats,
    "mapping_unmapped": lambda x: links.unmapped(x.items, x.links, x.exclusions),
    "mapping_upsert": mapping_upsert,
    "mapping_stored": mapping_stored,
    "mapping_rejected": mapping_rejected,
    "mapping_checked": mapping_checked,
    "mapping_exclude": mapping_exclude,
    "mapping_remove": lambda x: links.remove(x.links, "7", "7").select("icode", "working_code", "match_method"),
    "mapping_include": lambda x: links.include(x.exclusions, "25"),
    "reconcile_year": reconcile_year,
    "reconcile_month": reconcile_month,
    "reconcile_flags": reconcile_flags,
    "reconcile_flag_texts": reconcile_flag_texts,
    "reconcile_headline": reconcile_headline,
    "reconcile_item": reconcile_item,
    "stock_curve": stock_curve,
    "moving_average": moving_average,
    "month_share": month_share,
    "default_years": default_years,
    "years_back": years_back,
    "months_reordered": months_reordered,
    "terms_escaped": terms_escaped,
    "names_normalized": names_normalized,
    "names_thai": names_thai,
    "similarity_pairs": similarity_pairs,
    "similarity_thai": similarity_thai,
    "suggest_candidates": suggest_candidates,
    "auto_match_preview": auto_match_preview,
    "auto_match_default": auto_match_default,
    "auto_match_apply": auto_match_apply,
    "bulk_import_classified": lambda x: _bulk(x, True),
    "bulk_import_applied": lambda x: _bulk(x, False),
    "bulk_import_counters": bulk_import_counters,
    "bulk_import_after": bulk_import_after,
    "bulk_files_classified": bulk_files_classified,
    "bulk_files_counters": lambda x: bulk.counters(*_bulk_files(x, True)),
    "bulk_files_after": bulk_files_after,
    "number_texts": number_texts,
}


#: Queries that also run on facts laid out by fiscal year, there called ..._by_year.
BY_YEAR = ["h_years", "i_years", "merged_years", "h_monthly", "i_monthly", "i_item_monthly", "i_top_drugs", "h_year_summary", "i_year_summary", "stock_curve", "reconcile_year"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _inputs(query) for name, query in QUERIES.items()} | {f"{name}_by_year": _laid_out(QUERIES[name]) for name in BY_YEAR} | {"h_monthly_kept": h_monthly_kept, "i_monthly_kept": i_monthly_kept}
