"""Training-data operators: every one takes and returns DataFrames."""
