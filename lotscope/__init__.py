"""Listing-market analytics on Spark: DataFrame operators, plans and streams."""
