"""Set-based operators; every one takes and returns DataFrames."""
