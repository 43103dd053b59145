"""Registered queries: each composes operators over the given tables, with its SQL twin."""
