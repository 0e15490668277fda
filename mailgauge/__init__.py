"""Controlled experiments on e-mail classification, as Spark DataFrames."""
