"""Odds snapshots as they arrive."""
