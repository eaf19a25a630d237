"""functions of vectide."""
