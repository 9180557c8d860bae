"""Quillon: declarative model scoring and data-processing operators compiled to Spark plans."""
