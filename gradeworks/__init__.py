"""gradeworks: evaluation analytics for code-generation benchmarks, on Spark DataFrames."""
