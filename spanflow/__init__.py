"""Analytics of time-segmented recordings as DataFrame operators."""
