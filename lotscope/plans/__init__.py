"""Plans of the listing-market engine."""
