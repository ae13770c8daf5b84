"""Incremental forms of ingestion: new files or events are folded into the same tables the batch run builds."""
