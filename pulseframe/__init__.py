"""Detector data and experiment tables as Spark DataFrames."""
