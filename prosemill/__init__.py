"""prosemill: prose analytics, integrity checks and governed edits on Spark."""

__version__ = "0.1.0"
