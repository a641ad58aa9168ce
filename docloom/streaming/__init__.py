"""Structured Streaming forms of ingestion, quotas and throttling."""
