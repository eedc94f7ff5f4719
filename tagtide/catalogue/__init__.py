"""All registered queries."""

from tagtide.catalogue import adoption, ads, files, labels, posts, series, tagging, text, vectors  # noqa: F401
from tagtide.catalogue.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
