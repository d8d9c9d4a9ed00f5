"""Registered queries: operators applied to the tables, each beside its SQL twin."""
