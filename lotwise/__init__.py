"""Dynamic weighted sampling on PySpark: DataFrames in, DataFrames out."""
