"""orderloom: purchase-order mail analytics and data preparation on Spark DataFrames."""
