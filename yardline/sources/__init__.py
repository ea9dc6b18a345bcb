"""Input schemas, readers and the CSV sink."""
