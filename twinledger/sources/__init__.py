"""Readers: record files, staged-file checks, stored results."""
