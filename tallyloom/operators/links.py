"""The link store as tables: pure functions from (links, exclusions) to (links, exclusions), and what they tell.

One link a dispensed code is in force, the latest; a code is linked or excluded or neither. Changes come as tables,
so one call carries any number of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.tables import EXCLUSIONS, LINKS

METHODS = ("auto", "manual", "approved")


def checked(icode: str, working_code: str, method: str, score: float | None) -> tuple[str, str]:
    """The trimmed codes of a link to be set; raises ValueError if a rule is broken."""
    icode, working_code = icode.strip(), working_code.strip()
    if not icode or not working_code:
        raise ValueError("both codes are needed")
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if score is not None and not (math.isfinite(score) and 0.0 <= score <= 1.0):
        raise ValueError("a score lies between 0 and 1")
    return icode, working_code


def _trimmed(code: str) -> Column:
    return F.regexp_replace(F.coalesce(code, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _broken() -> Column:
    score = F.col("match_score")
    bad = (_trimmed("icode") == "") | (_trimmed("working_code") == "") | ~F.coalesce(F.col("match_method").isin(*METHODS), F.lit(False))
    return bad | F.coalesce(F.isnan(score) | ~score.between(0.0, 1.0), F.lit(False))


def invalid(links: DataFrame) -> DataFrame:
    """Links that break a rule."""
    return links.where(_broken())


def set_links(links: DataFrame, exclusions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, exclusions, rejected): the changes that keep the rules are applied, codes trimmed; the others come back as they were."""
    good = changes.where(~_broken()).withColumns({"icode": _trimmed("icode"), "working_code": _trimmed("working_code")})
    return *upsert(links, exclusions, good), invalid(changes)


def latest(links: DataFrame, key: str = "icode") -> DataFrame:
    """One link for each key: the one with the highest id."""
    order = Window.partitionBy(key).orderBy(F.desc("id"))
    return links.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert(links: DataFrame, exclusions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes: links without id, with `seq`, their order. The last change of a code stands; its old links and exclusion go."""
    top = links.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    last = Window.partitionBy("icode").orderBy(F.desc("seq"))
    new = changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").crossJoin(F.broadcast(top))  # top is one row
    new = new.withColumn("id", (F.col("top") + F.col("seq")).cast("long")).select(*LINKS.names)
    codes = new.select("icode").distinct().hint("merge")
    return links.join(codes, "icode", "left_anti").select(*LINKS.names).unionByName(new), exclusions.join(codes, "icode", "left_anti").select(*EXCLUSIONS.names)


def remove(links: DataFrame, icode: str, working_code: str) -> DataFrame:
    return links.where(~((F.col("icode") == icode) & (F.col("working_code") == working_code)))


def exclude(links: DataFrame, exclusions: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """marks: (icode, reason). Links of these codes go; a reason given before is replaced."""
    codes = marks.select("icode").distinct().hint("merge")
    return links.join(codes, "icode", "left_anti").select(*LINKS.names), exclusions.join(codes, "icode", "left_anti").select(*EXCLUSIONS.names).unionByName(marks.select(*EXCLUSIONS.names))


def include(exclusions: DataFrame, icode: str) -> DataFrame:
    return exclusions.where(F.col("icode") != icode)


def status_by_icode(codes: DataFrame, links: DataFrame, exclusions: DataFrame) -> DataFrame:
    """codes (icode, ...) with status (mapped, no_invs, unmapped), working_code, match_method, reason. A link wins over an exclusion."""
    link = latest(links).select("icode", "working_code", "match_method")
    excluded = exclusions.groupBy("icode").agg(F.max("reason").alias("reason"))
    # by merge: links compress so well that by the size of their files Spark would broadcast millions of them
    out = codes.join(link.hint("merge"), "icode", "left").join(excluded.hint("merge"), "icode", "left")
    linked = F.col("working_code").isNotNull()
    status = F.when(linked, "mapped").when(F.col("reason").isNotNull(), "no_invs").otherwise("unmapped")
    return out.withColumn("status", status).withColumn("reason", F.when(~linked, F.col("reason")))


def status_by_working_code(codes: DataFrame, links: DataFrame) -> DataFrame:
    """codes (working_code, ...) with status (mapped, unmapped), the latest linked icode and method."""
    link = latest(links, "working_code").select("working_code", "icode", "match_method")
    return codes.join(link.hint("merge"), "working_code", "left").withColumn("status", F.when(F.col("icode").isNotNull(), "mapped").otherwise("unmapped"))


def mapping_rows(items: DataFrame, links: DataFrame, exclusions: DataFrame, term: str, limit: int = 100, status: str | None = None) -> DataFrame:
    """(icode, drug_name, status, working_code, reason) of a page of the list: 1 to 100 items by name, null names first.

    status narrows the page after it is cut, as the list does.
    """
    low = term.lower()
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
    page = items.where(has("icode") | has("name")).orderBy("name", "icode").limit(max(1, min(100, limit)))
    out = status_by_icode(page.select("icode", F.coalesce("name", "icode").alias("drug_name")), links, exclusions)
    out = out.select("icode", "drug_name", "status", "working_code", "reason")
    return out if status is None else out.where(F.col("status") == status)


def stats(links: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(total, by_method map, exclusions), one row."""
    by = links.groupBy("match_method").count()
    one = by.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("match_method", "count")))).alias("by_method"))
    return one.crossJoin(F.broadcast(exclusions.agg(F.count("*").alias("exclusions"))))  # one row with one row


def unmapped(items: DataFrame, links: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Items neither linked nor excluded."""
    return items.join(links.select("icode").union(exclusions.select("icode")), "icode", "left_anti")


def next_unmapped(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (icode, status, ...) with next_icode: the first unmapped row after each, in this order of a page."""
    ahead = Window.orderBy(*order).rowsBetween(1, Window.unboundedFollowing)  # a page holds 100 rows at most
    return rows.withColumn("next_icode", F.first(F.when(F.col("status") == "unmapped", F.col("icode")), ignorenulls=True).over(ahead))
