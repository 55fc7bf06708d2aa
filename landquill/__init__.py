"""Analytics operators for land-survey and land-registry data, on Spark DataFrames."""
