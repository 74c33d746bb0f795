"""Dialogue-trial analytics on Spark DataFrames."""
