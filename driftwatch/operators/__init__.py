"""Detectors, joins with labelled events, windows and models, each a function from DataFrames to a DataFrame."""
