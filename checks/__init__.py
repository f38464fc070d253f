"""Queries over the given tables with an independent SQL for each."""

from checks import aggregates, cohorts, grids, identifiers, io, loading, matching, rolling_checks, rules, scoring, source_rules, units_checks
from checks.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
_ = (aggregates, cohorts, grids, identifiers, io, loading, matching, rolling_checks, rules, scoring, source_rules, units_checks)
