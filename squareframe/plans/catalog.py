"""Collects the registered queries from the catalog modules."""

from . import board_queries, job_queries, label_queries, learned_queries, move_queries, table_queries, tag_queries  # noqa: F401
from .registry import QUERIES


def all_queries():
    return QUERIES
