"""newslake: a news corpus as Spark tables.

Feeds, posts and pages become typed DataFrames; every operator is a function
from DataFrames (and Columns) to DataFrames, so Catalyst sees one plan per
report and can prune, push down and pick join strategies on its own.
"""

__version__ = "0.1.0"
