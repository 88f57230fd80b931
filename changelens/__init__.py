"""Change monitoring over versioned document tables, written as Spark jobs."""
