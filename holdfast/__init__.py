"""Replication jobs over time-stamped documents and series, on Spark DataFrames."""
