"""Searches in the two catalogs. Terms are plain text, upper and lower case alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM_LIMIT, CATALOG_LIMIT = 50, 30


def _has(column: str, term: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(term.lower())), F.lit(False))


def search_items(items: DataFrame, term: str, limit: int = ITEM_LIMIT) -> DataFrame:
    """(icode, name) where code or name has the term, by name; a missing or empty name shows the code."""
    shown = F.coalesce(F.nullif("name", F.lit("")), F.col("icode"))
    return items.where(_has("icode", term) | _has("name", term)).select("icode", shown.alias("name")).orderBy("name", "icode").limit(limit)


def search_catalog(catalog: DataFrame, term: str, limit: int = CATALOG_LIMIT, wildcards: bool = False) -> DataFrame:
    """(working_code, drug_name) where the code starts with the term or the name has it, by code.

    wildcards: % and _ in the term stand for any text and any character, as they would in an unescaped LIKE.
    """
    code, name, low = F.lower("working_code"), F.lower("drug_name"), term.lower()
    if wildcards:
        found = code.like(low + "%") | F.coalesce(name.like(f"%{low}%"), F.lit(False))
    else:
        found = F.startswith(code, F.lit(low)) | _has("drug_name", term)
    return catalog.where(found).select("working_code", F.trim(F.coalesce("drug_name", F.lit(""))).alias("drug_name")).orderBy("working_code", "drug_name").limit(limit)
