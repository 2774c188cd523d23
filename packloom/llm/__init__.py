"""Operators of a training-data pipeline over crawled text, and their queries.

Nothing else in the library imports this subpackage.
"""
