"""Whole reconciliations composed of the operators."""
