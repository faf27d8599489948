"""Pixel, component, batch and audit operators on DataFrames."""
