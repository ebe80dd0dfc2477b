"""Operators that reports and loading are built from."""
