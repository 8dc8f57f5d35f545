"""Skew-safe building blocks: history windows, row index, running totals, exact quantiles."""
