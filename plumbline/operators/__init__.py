"""Row-level operators over two DataFrames."""
