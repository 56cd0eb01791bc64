"""Readers and writers of the stage folders."""
