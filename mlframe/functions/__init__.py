"""functions of mlframe."""
