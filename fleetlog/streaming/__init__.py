"""Structured Streaming jobs: usage by window, deduplication, counter deltas, bursts, merges."""
