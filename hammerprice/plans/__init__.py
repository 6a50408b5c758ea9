"""Queries: operators put to work on the driver tables."""
