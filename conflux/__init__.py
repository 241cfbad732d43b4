"""Joins over tables at rest and over streams, written with Spark DataFrames."""
