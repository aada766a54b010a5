"""Scalar functions over sequences: Column expressions, and pandas functions where there is real recurrence."""
