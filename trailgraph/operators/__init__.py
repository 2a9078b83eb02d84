"""Graph construction, lookups, dataset expansion and splits."""
