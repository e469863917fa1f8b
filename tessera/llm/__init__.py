"""Operators of a training-data pipeline over documents and pages; nothing outside this folder imports them."""
