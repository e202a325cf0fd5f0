"""Document-corpus analytics on Spark: scan, parse, chunk, store, retrieve, maintain."""

__version__ = "0.1.0"
