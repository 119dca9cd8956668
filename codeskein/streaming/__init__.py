"""Change handling as Structured Streaming."""
