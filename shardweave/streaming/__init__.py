"""Log lines as a stream."""
