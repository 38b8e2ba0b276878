"""quiresift: near-duplicate analytics over ordered collections, on Spark."""

__version__ = "0.1.0"
