"""Search, filters, paging and lookup over the enriched table."""

import re

from pyspark.sql import Column, DataFrame, functions as F

from advisoryspark import fixed_values as fx
from advisoryspark.functions.text import excerpt

SEARCHED = ("CVE_ID", "Description", "Affected_Component")


def search_predicate(term: str) -> Column:
    """Case-insensitive substring match in any searched column.

    `%` and `_` in the term stay wildcards; a backslash is an ordinary character.
    """
    pattern = "%" + term.replace("\\", "\\\\") + "%"
    found = F.col(SEARCHED[0]).ilike(pattern)
    for column in SEARCHED[1:]:
        found = found | F.col(column).ilike(pattern)
    return found


def filter_records(records: DataFrame, search: str = "", severity: str = "ALL",
                   exploit: str = "ALL") -> DataFrame:
    """Optional conditions, all of which must hold; neutral values add none.

    The equality conditions come first and reach the parquet scan.
    """
    if severity != "ALL":
        records = records.filter(F.col("True_Severity") == severity.upper())
    if exploit != "ALL":
        records = records.filter(F.col("Exploit_Type") == exploit)
    if search:
        records = records.filter(search_predicate(search))
    return records


#: Columns too long to be hashed for an order.
LONG_COLUMNS = ("Description", "Cleaned_Description")


def page(records: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows offset+1 .. offset+limit, newest year first, then id descending (text order).

    Rows that repeat an id follow `row_hash`, so the pages are a cut of one fixed
    order.  Costs grow with `offset + limit`; to go through a large result use
    `page_after`.
    """
    return records.orderBy(*newest_first(records)).offset(offset).limit(limit)


def row_hash(records: DataFrame) -> Column:
    """Hash of a row's columns but the long texts; ids are the table's unique key, so it only orders repeated ones."""
    return F.xxhash64(*[c for c in records.columns if c not in LONG_COLUMNS])


def newest_first(records: DataFrame) -> list[Column]:
    return [F.desc("Year"), F.desc("CVE_ID"), row_hash(records)]


def page_after(records: DataFrame, limit: int = 100, year: str | None = None, cve_id: str | None = None,
               last_hash: int | None = None) -> DataFrame:
    """The `limit` rows that follow (year, cve_id), the last key of the page before; the first page without.

    The key is a filter on the scan, so every page costs the same top-n.  With the
    last row's `row_hash` the page goes on inside a repeated id, else it starts
    behind the id.
    """
    if year is not None:
        behind = F.col("CVE_ID") < cve_id
        if last_hash is not None:
            behind = behind | ((F.col("CVE_ID") == cve_id) & (row_hash(records) > last_hash))
        records = records.filter((F.col("Year") < year) | ((F.col("Year") == year) & behind))
    return records.orderBy(*newest_first(records)).limit(limit)


def page_envelope(matching: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """One row: total matches, first and last shown, has-previous, has-next."""
    total = F.col("total")
    last = F.least(total, F.lit(offset + limit).cast("bigint"))
    return matching.agg(F.count(F.lit(1)).alias("total")).select(
        total,
        F.lit(offset + 1).cast("bigint").alias("start_row"),
        last.alias("end_row"),
        F.lit(offset > 0).alias("has_prev"),
        (last < total).alias("has_next"),
    )


def lookup(records: DataFrame, cve_id: str) -> DataFrame:
    """The record with exactly this id; a malformed id is refused."""
    wanted = cve_id.strip().upper()
    if not re.fullmatch(fx.ID_FORMAT, wanted):
        raise ValueError(f"malformed id {cve_id!r}")
    return records.filter(F.col("CVE_ID") == wanted)


def head(records: DataFrame, n: int, order=("Year", "CVE_ID")) -> DataFrame:
    """First n rows in an explicit order."""
    return records.orderBy(*order).limit(n)


def report_excerpt(records: DataFrame) -> DataFrame:
    """Opening of the raw and of the cleaned text, as shown above a report."""
    return records.select(
        "CVE_ID",
        excerpt(F.col("Description")).alias("raw_excerpt"),
        excerpt(F.col("Cleaned_Description")).alias("cleaned_excerpt"),
    )
