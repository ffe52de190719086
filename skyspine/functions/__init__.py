"""Scalar building blocks: every function takes and returns columns."""
