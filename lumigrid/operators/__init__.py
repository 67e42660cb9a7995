"""Relational operators over images, features, samples and boxes."""
