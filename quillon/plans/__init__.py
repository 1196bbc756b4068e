"""Queries that put the operators to work on the driver's tables."""
