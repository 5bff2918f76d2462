"""Feature scaling and score models on Spark ML."""
