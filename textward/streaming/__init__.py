"""The jobs on Structured Streaming."""
