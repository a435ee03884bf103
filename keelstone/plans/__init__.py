"""Resolve plans and the registered queries."""
