"""Sweep specifications, fixture views and the query catalog."""
