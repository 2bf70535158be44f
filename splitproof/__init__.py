"""Dataset-integrity analytics on Spark."""
