"""The analytical queries, one function each."""
