"""strandlake sources."""
