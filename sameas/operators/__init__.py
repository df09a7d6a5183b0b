"""Entity-resolution operators; each takes and returns DataFrames."""
