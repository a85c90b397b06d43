"""Operators on DataFrames: detection, masking, restoring."""
