"""Operators of a training-data pipeline over ``documents`` and ``conversations``.

Nothing else in the library imports this package.  ``queries`` holds one entry per operator.
"""
