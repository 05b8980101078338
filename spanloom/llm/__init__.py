"""Operators of a training-data pipeline over large corpora; nothing else in the package imports them."""
