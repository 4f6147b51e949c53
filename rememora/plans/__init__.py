"""Analytics plans and the registry of runnable queries."""
