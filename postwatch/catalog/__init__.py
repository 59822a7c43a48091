"""Every operator as a query over the given tables, with SQL that gives the same rows."""

from postwatch.catalog import evaluation, features, learning, posts, sources, streams, text, windows
from postwatch.catalog.base import QUERIES, SQL

__all__ = [
    "QUERIES", "SQL", "evaluation", "features", "learning", "posts", "sources", "streams", "text",
    "windows",
]
