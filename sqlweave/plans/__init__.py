"""Registered queries: each family module maps a name to a builder and its SQL twin."""
