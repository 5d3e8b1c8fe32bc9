"""sources of mlframe."""
