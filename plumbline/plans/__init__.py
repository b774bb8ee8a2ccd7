"""Whole-audit plans: per-file facts, the scorecard and the report tables."""
