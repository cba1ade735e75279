"""Whole flows: training, prediction, diagnostics."""
