"""Run and asset events, batch and Structured Streaming."""
