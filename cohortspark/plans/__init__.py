"""Registered queries: the operators applied to the given tables."""

from cohortspark.plans import cohort, lookup, modelling, profiles, scoring, storage, study_tables  # noqa: F401
from cohortspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
