"""Cost-aware, source-verified enrichment of entity lists as Spark jobs."""

__version__ = "0.1.0"
