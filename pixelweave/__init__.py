"""Segmentation analytics on Spark: pixel, instance, annotation and score tables as DataFrames."""
