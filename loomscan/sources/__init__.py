"""Where captured responses come from and results go to."""
