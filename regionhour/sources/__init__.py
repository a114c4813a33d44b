"""Typed readers of raw files and writers of processed tables."""
