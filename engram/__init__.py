"""Conversational-memory analytics on Spark DataFrames."""
