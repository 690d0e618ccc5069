"""Named queries of the core engine and their SQL."""
