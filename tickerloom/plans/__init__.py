"""Whole runs: from candle files to stored results."""
