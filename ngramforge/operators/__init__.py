"""Counting, statistics, pruning, lexicons and segmentation over DataFrames."""
