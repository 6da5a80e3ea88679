"""The analytical queries. Each takes ``Tables`` and returns a lazy DataFrame."""
