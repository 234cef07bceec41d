"""Operators of a training-data pipeline; ``queries`` registers one query for each."""
