"""Whole stages, their inputs from the driver tables, and the query catalogue."""
