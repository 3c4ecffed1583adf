"""Reading and writing tables, logs and partitioned layouts."""
