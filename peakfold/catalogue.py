"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from peakfold.plans import catalogs, formats, matching, operations, scalars  # noqa: F401  they register their queries
from peakfold.plans import queries as plans


def entry(spark, sf_dir: str):
    return plans.flagship(spark, sf_dir)


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQLS)
