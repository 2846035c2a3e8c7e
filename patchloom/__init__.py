"""Set cover and hash statistics over patches (bags of 64-bit hashes), on Spark DataFrames."""
