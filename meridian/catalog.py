"""The registries of the library's queries and of the SQL that they are checked against."""

from .plans import cleaning, eda, exports, findings, io, joins, measures, quality, relations, semantic, texts  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
