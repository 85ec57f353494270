"""pagemill: a Spark-first engine that turns scanned, page-structured books into checked datasets."""

__version__ = "0.1.0"
