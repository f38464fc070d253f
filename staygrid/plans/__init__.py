"""Concept specs and the plans that load them."""
