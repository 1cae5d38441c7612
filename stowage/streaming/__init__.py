"""Structured Streaming jobs over landed bundles and audit records."""
