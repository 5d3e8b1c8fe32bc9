"""streaming of mlframe."""
