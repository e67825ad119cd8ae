"""Imports every query module, which registers its queries."""

from workload import (  # noqa: F401
    inference_queries,
    job_queries,
    profile_queries,
    scoring_queries,
    source_queries,
    text_queries,
)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
