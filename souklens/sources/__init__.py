"""Readers and writers of the stores the model federates."""
