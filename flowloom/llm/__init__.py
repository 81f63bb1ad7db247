"""Operators of a training-data pipeline over text, urls and vectors."""
