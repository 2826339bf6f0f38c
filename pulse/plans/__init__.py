"""Whole pipelines and reports built from the operators."""
