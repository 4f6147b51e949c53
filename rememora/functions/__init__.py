"""Column-level building blocks: text, lifecycle, identity, vectors."""
