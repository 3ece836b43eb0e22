"""Streaming of the listing-market engine."""
