"""Registered queries: operators applied to the tables of the driver contract."""
