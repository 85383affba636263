"""Page-text and topic analytics as DataFrame-in / DataFrame-out Spark operators."""
