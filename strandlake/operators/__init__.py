"""strandlake operators."""
