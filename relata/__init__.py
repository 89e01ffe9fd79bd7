"""Relatedness analytics over linked, categorised documents, on Spark DataFrames."""
