"""All queries over the driver tables and the SQL that gives the same rows."""

from .plans import catalogue, files, jobs, oracle

QUERIES = catalogue.QUERIES | jobs.QUERIES | files.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | jobs.ORACLE_SQL | files.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
