"""Queries put together from operators, and their SQL."""
