"""Structured Streaming forms of the service and adjudication jobs."""
