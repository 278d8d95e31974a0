"""gristmill: preparing and controlling tabular data with Spark DataFrames."""
