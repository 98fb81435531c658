"""Scalar functions on bytes and numbers, plain and as columns."""
