"""operators of mlframe."""
