"""postwatch: short-text surveillance on Spark.

Ingest of nested JSON posts, term tagging, keyword and hashtag extraction, windowed roll-ups,
text features, splits, classifier evaluation.  Everything takes and returns DataFrames.
"""

__version__ = "0.1.0"
