"""plans of mlframe."""
