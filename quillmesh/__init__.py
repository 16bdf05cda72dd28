"""Point-in-time news and market analytics expressed as Spark plans."""

__version__ = "0.1.0"
