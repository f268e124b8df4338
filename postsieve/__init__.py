"""postsieve: message scanning and text-corpus processing as Spark DataFrame operators."""

__version__ = "0.1.0"
