"""Operators of this layer; see the package README."""
