"""Builders that turn configuration into Column expressions."""
