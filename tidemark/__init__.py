"""Tidemark: text measurement, event windows and regression on Spark DataFrames."""
