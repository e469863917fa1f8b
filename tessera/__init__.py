"""Batch evidence-integration and training-data operators for Spark."""
