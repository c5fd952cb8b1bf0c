"""arrayloom: array and table analytics on Spark DataFrames."""
