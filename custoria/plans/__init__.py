"""User-level results composed from the operators."""
