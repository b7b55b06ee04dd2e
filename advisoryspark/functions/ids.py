"""Identifier normalisation, validation and the year inside an identifier."""

from pyspark.sql import Column, functions as F

from advisoryspark import fixed_values as fx


def normalize_id(cve_id: Column) -> Column:
    return F.upper(F.regexp_replace(cve_id, r"(?U)^\s+|\s+$", ""))


def is_valid_id(cve_id: Column, strict: bool = True) -> Column:
    return F.coalesce(cve_id.rlike(fx.ID_FORMAT if strict else fx.LOOSE_ID_FORMAT), F.lit(False))


def year_from_id(cve_id: Column) -> Column:
    year = F.nullif(F.regexp_extract(cve_id, fx.ID_YEAR, 1), F.lit(""))
    return F.coalesce(year, F.lit(fx.DEFAULT_YEAR))


def year_from_published(published: Column) -> Column:
    return F.substring(F.coalesce(published, F.lit("0000")), 1, 4)
