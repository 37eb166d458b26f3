"""tidemark: analytics over activity logs and text or source collections, written for Spark."""

__version__ = "0.1.0"
