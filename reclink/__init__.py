"""Joint record linkage and text segmentation on Spark DataFrames."""
