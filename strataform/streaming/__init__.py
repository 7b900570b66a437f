"""Event-time operators in batch and Structured Streaming."""
