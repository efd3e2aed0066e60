"""Appending streams of quads to a saved store."""
