"""flowlens.functions."""
