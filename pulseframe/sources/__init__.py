"""Readers that turn detector files and folders into DataFrames."""
