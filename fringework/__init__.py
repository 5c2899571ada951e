"""Array-signal analytics over long-form DataFrames, planned by Spark."""
