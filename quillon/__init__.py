"""Full-text search and text analytics as Spark plans."""
