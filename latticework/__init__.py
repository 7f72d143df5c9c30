"""Sparse-matrix resampling and analysis on Spark."""
