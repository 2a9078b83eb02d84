"""Bundles that arrive over time."""
