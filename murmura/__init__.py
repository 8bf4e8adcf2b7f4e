"""murmura: multi-instance, multi-label feature analytics on Spark DataFrames."""
