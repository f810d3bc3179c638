"""Operators on entities, signals, matrices, kernels and metrics."""
