"""Operators of a training-data pipeline over text, page, chat and vector tables.

Nothing else in the package imports this subpackage. ``queries.py`` holds the
registered queries and their SQL.
"""
