"""Edition files, lookup dimensions and stage tables."""
