"""Functions of the listing-market engine."""
