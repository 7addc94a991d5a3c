"""Decision rules as data, compiled to Spark plans."""

__version__ = "0.1.0"
