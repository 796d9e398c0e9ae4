"""flowlens.plans."""
