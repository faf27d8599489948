"""Glyphlake: audited image-batch analytics and corpus operators on Spark DataFrames."""
