"""Sensitive-text analytics on Spark: find, classify, suppress and mask secrets and personal data."""

__version__ = "0.1.0"
