"""Readers, and the model's tables as views of the stored ones."""
