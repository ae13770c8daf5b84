"""Reading and writing: candle files, stage tables, feed payloads, and tables shaped from a star schema."""
