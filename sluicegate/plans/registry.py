"""Registered queries and the SQL that gives the same rows.  Importing this module registers all of them."""

from __future__ import annotations

from sluicegate.plans.base import ORACLES, QUERIES
from sluicegate.plans import q_corpus, q_estimates, q_gates, q_labelled, q_matching, q_norms, q_office, q_references, q_registries, q_rules, q_selection, q_signals, q_sources, q_tables  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
