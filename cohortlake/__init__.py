"""Cohortlake: membership analytics over time-bucketed segments on Spark DataFrames."""
