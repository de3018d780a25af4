"""Column builders: settlement, freshness, keys, text and money functions."""
