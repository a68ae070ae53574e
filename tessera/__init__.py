"""Approximate analytics on Spark: reproducible stratified samples, linear queries with confidence limits, windows."""
