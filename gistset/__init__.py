"""Set-summary analytics over Spark DataFrames: bitmaps, Bloom filters, HyperLogLog, MinHash."""
