"""Part of the price library."""
