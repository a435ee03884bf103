"""Change-log ingestion by Structured Streaming."""
