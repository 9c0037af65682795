"""Corpus preparation for training data: ten operators, each with a query.

Nothing else in the library imports this subpackage. ``queries`` holds the thin
registered queries, the other modules hold the operators with their own interface.
"""
