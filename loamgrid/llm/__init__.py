"""Training-data operators on records and texts."""
