"""File changes as a stream."""
