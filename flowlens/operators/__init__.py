"""flowlens.operators."""
