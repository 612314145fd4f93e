"""Readers and writers. Every reader returns a DataFrame of a schema in ``helixframe.schemas``."""
