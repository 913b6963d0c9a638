"""Operators of a training-data pipeline over large text tables; nothing outside this package imports it."""
