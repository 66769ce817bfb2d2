"""roundel: iterative map-reduce-update analytics on DataFrames."""
