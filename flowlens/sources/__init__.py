"""flowlens.sources."""
