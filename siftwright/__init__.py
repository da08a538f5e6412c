"""Source-analytics engine on PySpark: scan, score and report a corpus of source files."""

__version__ = "0.1.0"
