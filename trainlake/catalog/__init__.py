"""Registered queries: operators applied to the driver's tables, and the SQL that gives the same rows."""
