"""strandlake streaming."""
