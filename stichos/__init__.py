"""stichos: corpus-scale restoration analytics for damaged ancient texts on Spark."""
