"""The incremental chain as Structured Streaming jobs."""
