"""Text to syntax trees, and syntax trees to Spark SQL."""
