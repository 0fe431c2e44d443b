"""strandlake functions."""
