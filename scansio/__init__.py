"""Preparation, sampling and scoring of annotated verse on Spark DataFrames."""
