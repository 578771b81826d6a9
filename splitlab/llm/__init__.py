"""Operators of a training-data pipeline: mixing, filters, near copies, tokens, shards.

Nothing else in the library imports this package. Texts are processed whole; null texts count as empty
unless an operator says otherwise.
"""
