"""Corpus operators for training-data pipelines (text in, decisions out).

Nothing else in the library imports this subpackage. ``queries`` holds the
registered queries and their SQL; each other module is one operator.
"""
