"""flowlens.streaming."""
