"""streaming of vectide."""
