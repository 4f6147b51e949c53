"""Readers and writers for corpora, runs, caches, traces and chat state."""
