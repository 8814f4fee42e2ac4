"""skyloom: maximum-likelihood map-making and timestream analytics on Spark DataFrames."""
