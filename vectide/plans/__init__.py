"""plans of vectide."""
