"""Task state as a stream."""
