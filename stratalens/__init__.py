"""Traffic and health analytics for public time servers, on Spark DataFrames."""
