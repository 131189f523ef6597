"""Versioned key-value analytics on Spark: mutation logs folded into latest-value state."""
