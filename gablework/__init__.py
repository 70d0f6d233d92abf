"""Listing analytics on Spark: free-text property listings to typed features, quality, prices and alerts."""
