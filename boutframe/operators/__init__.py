"""DataFrame operators: joins, windows and aggregates over contest tables."""
