"""millrace: crawled pages to clean, deduplicated text corpora, as Spark plans."""

from millrace.session import get_spark

__all__ = ["get_spark"]
