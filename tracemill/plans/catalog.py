"""Importing the plan modules fills the registry."""

from tracemill.plans import blueprint_plans, catalogue_plans, corpus_plans, dialogue_plans, packaging_plans, scoring_plans, state_plans, text_plans  # noqa: F401
from tracemill.plans.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
