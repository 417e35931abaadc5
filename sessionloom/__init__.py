"""Session-trace analytics on Spark: see README.md for the layout."""
