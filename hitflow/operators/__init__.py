"""One module per stage; each operator is a function from DataFrames to a DataFrame."""
