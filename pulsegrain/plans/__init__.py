"""Saved SQL metrics, and the catalogue of checked queries over the driver tables."""
