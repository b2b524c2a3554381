"""Scalar text, JSON and array expressions."""
