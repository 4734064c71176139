"""Structured Streaming jobs (X1-X3): the batch operators applied per micro-batch."""
