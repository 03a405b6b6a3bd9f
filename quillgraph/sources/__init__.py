"""Reading workspaces and logs, writing tables."""
