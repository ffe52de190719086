"""Charter-aviation analytics on Spark: clean, key, link, roll up and search at scale."""
