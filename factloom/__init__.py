"""Data-trust operators for PySpark: every operator takes and returns DataFrames."""
