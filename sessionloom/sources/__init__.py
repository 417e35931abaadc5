"""Scans of files and stores into DataFrames."""
