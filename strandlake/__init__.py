"""strandlake: comparative-sequence analytics as declarative Spark plans."""
