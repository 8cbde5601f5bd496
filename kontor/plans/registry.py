"""All queries of the library and their SQL: each module adds its own to one table."""

from kontor.plans import function_queries, job_queries
from kontor.plans.report_queries import SQL
from kontor.plans.report_queries import Q as QUERIES

__all__ = ["QUERIES", "SQL", "function_queries", "job_queries"]
