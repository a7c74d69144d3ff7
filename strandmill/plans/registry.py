"""All queries of the genomics side by name."""

from . import family_queries, fields, files, kernels, records, relational  # noqa: F401


def queries() -> dict:
    return dict(relational.QUERIES) | dict(kernels.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(relational.SQL)
