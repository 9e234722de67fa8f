"""The engine over micro-batches."""
