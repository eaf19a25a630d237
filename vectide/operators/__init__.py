"""operators of vectide."""
