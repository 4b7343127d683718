"""Operators for large-scale training-data preparation.

Each module holds one operator with its general interface; ``queries`` holds the
thin registered queries and ``oracle`` the SQL they are compared with.
"""
