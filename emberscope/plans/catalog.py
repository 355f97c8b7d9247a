"""All registered queries."""

from emberscope.plans import queries_clean, queries_io, queries_models, queries_reports, queries_series, queries_stream  # noqa: F401
from emberscope.plans.registry import QUERIES

__all__ = ["QUERIES"]
