"""DataFrame operators over the canonical tables."""
