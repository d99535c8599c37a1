"""The registered queries, one per operator, and the SQL that each must agree with."""

from . import changes, documents, graphs, reads, searches, sqltexts, typing, vectors

MODULES = (reads, sqltexts, typing, searches, vectors, graphs, documents, changes)


def queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: text for module in MODULES for name, text in module.ORACLE.items()}
