"""DataFrame -> DataFrame operators (lazy, keyed)."""
