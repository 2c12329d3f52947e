"""Row-local features over streaming DataFrames."""
