"""Live feeds: Structured Streaming from source to store."""
