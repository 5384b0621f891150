"""Backup plans and the queries of the test tables."""
