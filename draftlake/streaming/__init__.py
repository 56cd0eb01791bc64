"""Incremental versions of the stages."""
