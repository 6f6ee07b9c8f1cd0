"""Query registry and flagship plans."""
