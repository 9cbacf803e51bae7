"""sparktext: byte-exact full-text search, suffix indexes and corpus preparation on PySpark."""

__version__ = "0.1.0"
