"""Registered queries over the given tables, and the jobs that chain operators."""
