"""Changelog folding, in batches and as a stream."""
