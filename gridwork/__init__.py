"""Harmonize messy, table-like files into one audited dataset with Spark DataFrames."""
