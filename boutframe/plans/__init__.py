"""Whole jobs, the domain views over the star schema, and the query catalogue."""
