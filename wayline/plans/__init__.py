"""Stored tables, and the plans that read as little of them as a query needs."""
