"""Whole queries: chains of operators, and the catalog with its SQL."""
