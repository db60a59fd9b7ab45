"""loomstone: catalogue curation and text classification as Spark DataFrame operators."""

__version__ = "0.1.0"
