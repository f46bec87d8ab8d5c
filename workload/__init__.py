"""Queries on the provided tables, one per operator, with their SQL."""

from workload import q_features, q_learners, q_models, q_plans, q_profile, q_ranking, q_tables, q_values  # noqa: F401
from workload.registry import REGISTRY

__all__ = ["REGISTRY"]
