"""Operators of a training-data pipeline over document tables.

One module per operator; ``queries`` binds them to the supplied tables.
Nothing outside this package imports it.
"""
