"""Chart-object analytics and corpus operators on Spark."""
