"""Scalar functions and the template language."""
