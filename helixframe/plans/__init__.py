"""Registered queries and command line."""
