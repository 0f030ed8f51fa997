"""Text segmentation and corpus preparation on Spark DataFrames."""
