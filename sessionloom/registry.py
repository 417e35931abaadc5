"""All registered queries of the library, and the SQL that gives the same rows."""

from .plans.bindings import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
