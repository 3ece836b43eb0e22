"""Sources of the listing-market engine."""
