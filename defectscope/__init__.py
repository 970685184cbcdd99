"""Software-quality analytics for many repositories at once, as Spark jobs."""
