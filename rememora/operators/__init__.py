"""DataFrame-to-DataFrame operators keyed by chat and, when ranking, query."""
