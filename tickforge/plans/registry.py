"""All queries over the driver's tables, each with SQL where SQL can express it."""

from . import allocation, barsets, ingest, labelling, micro, models, risk  # noqa: F401  (they register themselves)
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
