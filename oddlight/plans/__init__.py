"""Whole plans: the algorithms composed from operators, fit objects, and the query registry."""
