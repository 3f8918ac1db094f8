"""Queries over the given tables: operators bound to columns, each with the SQL that gives the same rows."""

from . import content, ranking, records, rules  # noqa: I001
from . import feeds, links, names
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "content", "feeds", "links", "names", "ranking", "records", "rules"]
