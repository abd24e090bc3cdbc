"""Dataset operators on DataFrames."""
