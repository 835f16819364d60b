"""DataFrame to DataFrame operators over the price tables."""
