"""Registered queries: operators applied to the provided tables, with their SQL."""
