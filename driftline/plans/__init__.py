"""Whole analyses (compositions of operators) and plan helpers."""
