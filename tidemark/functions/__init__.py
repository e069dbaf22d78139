"""Part of the tidemark point-in-time analytics engine."""
