"""listingflow: refining, resolving and serving listing data on Spark."""
