"""All queries of the engine and the SQL that gives the same rows."""

from quernel.plans import columnar, containers, templates
from quernel.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "columnar", "containers", "templates"]
