"""Dataset curation, leakage-safe splitting, balanced sampling and classifier evaluation on Spark."""

__version__ = "0.1.0"
