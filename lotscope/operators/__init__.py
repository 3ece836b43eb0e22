"""Operators of the listing-market engine."""
