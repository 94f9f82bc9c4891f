"""Operators for preparing language-model training data.

Nothing outside this folder imports it. Each module holds one operator with
its own general interface; ``queries.py`` registers the driver's queries.
"""
