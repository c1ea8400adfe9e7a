"""leafmill: page-document analytics as declarative PySpark plans."""
