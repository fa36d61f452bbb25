"""Operators for preparing language-model training data, built on Spark DataFrames."""
