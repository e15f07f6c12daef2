"""inkframe: Spark operators over scanned, text-bearing pages and their recognition results."""

__version__ = "0.1.0"
