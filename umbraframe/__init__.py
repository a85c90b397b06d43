"""Reversible masking of personal data in DataFrames, and operators for training data."""
