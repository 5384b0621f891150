"""Operators of a training-data pipeline; the rest of the library never imports them."""
