"""Text-evidence analytics on Spark DataFrames."""
