"""News-feed building and querying on Spark: extract, ingest, page, search, digest."""
