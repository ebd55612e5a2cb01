"""Cleaning, profiling, quality and document-context operators for Spark tables.

Every operator takes DataFrames and returns a DataFrame, except the few that
return plan-time metadata (column roles) or bounded scalars (exact quantiles).
"""
