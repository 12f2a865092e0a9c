"""Scalar functions as Column expressions, and small driver-side mathematics."""
