"""The row rules of the batch side as Structured Streaming jobs."""
