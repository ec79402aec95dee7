"""Registered queries over the given tables."""

from cohortlens.catalog import (  # noqa: F401  (importing registers)
    q_drift,
    q_evaluation,
    q_features,
    q_models,
    q_panel,
    q_prepare,
    q_profile,
    q_score,
    q_streams,
)
from cohortlens.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
