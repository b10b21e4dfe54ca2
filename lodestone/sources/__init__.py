"""Where files come from, and the shared folder that intermediate tables go to."""
