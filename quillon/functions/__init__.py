"""Scalar functions of the formula and model languages."""
