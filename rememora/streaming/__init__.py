"""Structured Streaming state machines for the live path."""
