"""sources of vectide."""
