"""flowlens: network-flow security analytics on PySpark."""
