"""Registered queries and their SQL twins."""

from checks import corpus_queries, token_queries, vector_queries
from checks.registry import ORACLES, QUERIES
from checks.token_queries import flagship

__all__ = ["ORACLES", "QUERIES", "corpus_queries", "flagship", "token_queries", "vector_queries"]
