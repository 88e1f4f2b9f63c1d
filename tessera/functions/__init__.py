"""Scalar and array functions as column expressions."""
