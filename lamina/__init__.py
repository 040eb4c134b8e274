"""Volumetric label analytics and training-data preparation on Spark DataFrames."""
