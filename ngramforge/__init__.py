"""Unsupervised n-gram statistics and segmentation on Spark DataFrames."""
