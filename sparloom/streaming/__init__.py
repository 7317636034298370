"""Change capture over micro-batches."""
