"""Graph and array operators; every function takes and returns lazy DataFrames or columns."""
