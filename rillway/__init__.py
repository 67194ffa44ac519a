"""rillway: user-behaviour analytics on Spark DataFrames, SQL and Structured Streaming."""
