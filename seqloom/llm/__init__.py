"""Operators for preparing text and sequence collections for model training."""
