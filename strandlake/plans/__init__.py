"""strandlake plans."""
